"""The stages against plain versions on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmask.llm import secrets
from tests.llm.test_pair_operators import plain_near
from tests.llm.test_text_operators import DOCS, ODD, folder, labelled, plain_windows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(21)
    rows = labelled(160)
    texts = [r[0] for r in rows]
    texts += [texts[i] for i in range(0, 40, 7)] + [texts[i] + " more" for i in range(1, 40, 6)]
    items = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(14))) for i in range(5)]
    texts += [f"the river runs and {items[2][1]} over the stones today", "the grass and the river token = \"0123456789abcdef0123456789abcdef\" runs over stones"]
    texts += ODD
    data = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    marks = [(i, r[1], r[2]) for i, r in enumerate(rows)]
    path = tmp_path_factory.mktemp("corpus")
    d = folder(
        spark, path,
        documents=spark.createDataFrame(data, DOCS), labels=spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"),
    )
    return d, texts, items, rows


def test_stages_one_by_one(spark, corpus, tmp_path):
    d, texts, items, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        ids = sorted(before)
        if name == "quality":
            wrong = [i for i in range(len(rows)) if (i in kept[name]) != bool(rows[i][1])]
            assert len(wrong) <= 8 and kept[name].items() <= before.items()
        elif name == "near_duplicates":
            groups = plain_near([before[i] for i in ids], 5, 80)
            assert kept[name] == {i: before[i] for k, i in enumerate(ids) if groups[k][1] == k}
        elif name == "decontamination":
            hits = plain_windows([before[i] for i in ids], items)
            assert kept[name] == {i: before[i] for i, h in zip(ids, hits, strict=True) if not h[4]}
            assert len(before) - len(kept[name]) == 1
        elif name == "secrets":
            assert set(kept[name]) == set(before) and docs.where("n_chars <> length(text)").count() == 0
            changed = [i for i in ids if kept[name][i] != before[i]]
            assert len(changed) == 1 and "[secret]" in kept[name][changed[0]] and "0123456789abcdef" not in kept[name][changed[0]]
        else:
            assert kept[name].items() <= before.items() and 0 < len(kept[name]) < len(before)
            assert {"topic", "n_tokens", "probability"} <= set(docs.columns)


def test_rows_that_ids_do_not_name(spark, corpus):
    d, _, items, _ = corpus
    text, leak = "one two three four five six seven eight nine ten", f"some words and {items[2][1]} after"
    rows = [(None, text), (None, text), (3, text), (3, text), (4, "a clean row of its own words here"), (4, leak), (None, leak), (None, "words of another row without an id"), (None, None)]
    given = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    clean = sorted([r for r in rows if r[1] != leak], key=repr)
    assert seen(corpus_pipeline.drop_benchmark(spark, given, d)) == clean
    one = [(3, text), (4, rows[4][1]), (4, leak), (None, rows[7][1]), (None, None)]
    assert seen(corpus_pipeline.drop_near_copies(spark, given, d)) == sorted(one, key=repr)


def test_run_gives_the_last_stage(spark, corpus):
    d, texts, _, _ = corpus
    out = corpus_pipeline.run(spark, d)
    assert out.select("doc_id").distinct().count() == out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_run_over_nothing(spark, corpus, tmp_path):
    d = corpus[0]
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    empty = folder(spark, tmp_path, documents=read("documents").limit(0), labels=read("labels").limit(0), benchmark=read("benchmark").limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_columns_beyond_those_of_documents_pass(spark, corpus):
    d = corpus[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({"found": F.lit(1), "score": F.lit("x"), "id": F.lit(2), "kept": F.lit(True), "odd name.x": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name


def test_marks_are_not_secrets():
    assert secrets.find(["[secret] [secret]"], secrets.machine(), {k: __import__("re").compile(p) for k, p in secrets.PATTERNS.items()}) == [[]]
