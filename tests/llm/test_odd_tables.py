"""Nulls in any column, empty tables, repeated rows, and columns whose names clash with what operators use."""

import pytest
from pyspark.sql import functions as F

from sparkmask.llm import decontam, html, licenses, mixing, neardup, pii, quality, secrets, toxicity, vectors
from tests.llm.test_text_operators import ODD, docs, labelled

CLASHES = "id text_ score predicted found spans base candidates n set_a bands sketch bucket component items ranges n_words weight tokens label cell v y".split()


def odd(spark):
    """Odd texts, each twice, with null languages and sources and columns of names that operators use inside."""
    df = docs(spark, ODD + ODD)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).withColumn("n_chars", F.lit(None).cast("long"))


@pytest.fixture(scope="module")
def models():
    rows = labelled(120)
    return (
        toxicity.train([r[0] for r in rows], [r[2] for r in rows]),
        quality.train(quality.features([r[0] for r in rows]), __import__("numpy").array([r[1] for r in rows]), 0.7),
    )


def operators(spark, models):
    items = spark.createDataFrame([(1, "same text here"), (None, None)], "item_id long, text string").withColumn("id", F.lit("x"))
    return {
        "toxicity": lambda d: toxicity.apply(d, models[0]),
        "quality": lambda d: quality.apply(d, models[1]),
        "pii": lambda d: pii.personal_data(d),
        "neardup": lambda d: neardup.near_duplicates(d),
        "decontam": lambda d: decontam.contamination(d, items),
        "mixing": lambda d: mixing.mix(d, {"source": 0.5, "lang": 0.5, "topic": 1.0}),
        "secrets": lambda d: secrets.secrets(d),
    }


NAMES = ["toxicity", "quality", "pii", "neardup", "decontam", "mixing", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, models, name):
    out = operators(spark, models)[name](odd(spark))
    ids = sorted(r["doc_id"] for r in out.collect())
    assert ids == list(range(2 * len(ODD)))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, models, name):
    assert operators(spark, models)[name](odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontam", "secrets"])
def test_rows_without_ids_are_rows(spark, models, name):
    df = odd(spark).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert operators(spark, models)[name](df).count() == 2 * len(ODD)


@pytest.mark.parametrize("name", ["pii", "neardup", "mixing"])
def test_rows_with_null_and_repeated_ids_are_rows(spark, models, name):
    df = odd(spark).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id") % 4))
    out = operators(spark, models)[name](df)
    assert out.count() == 2 * len(ODD) and sorted(out.select("doc_id").collect(), key=repr) == sorted(df.select("doc_id").collect(), key=repr)


def test_notices_of_null_and_repeated_ids_and_of_long_texts(spark):
    notice = "Released under the MIT License."
    long = "words of a long text without end " * 30_000
    rows = [(None, notice), (None, notice), (1, notice), (1, f"{long}. {notice} {long}"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("own"))
    out = licenses.license_blocks(df).collect()
    assert sorted(((r["doc_id"], r["license"], r["exact"]) for r in out), key=repr) == sorted([(None, "MIT", True)] * 2 + [(1, "MIT", True)] * 2, key=repr)
    assert {r["start"] for r in out} == {0, len(long) + 2}


def test_notices_that_tie_are_told_once(spark):
    df = spark.createDataFrame([(1, "Licensed under the MIT License. Licensed under the MIT License.")], "doc_id long, text string")
    out = licenses.license_blocks(df).collect()
    assert [(r["license"], r["n_words"]) for r in out] == [("MIT", 5)] * 2


def test_pages_with_null_and_repeated_ids(spark):
    rows = [(None, "<p>one page</p>"), (None, "<p>two pages</p>"), (1, "<p>one page</p>"), (1, "<p>one page</p>")]
    out = html.article_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted(((r["page_id"], r["text"]) for r in out), key=repr) == sorted([(i, t[3:-4]) for i, t in rows], key=repr)


def test_repeated_texts_score_alike(spark, models):
    for name in ("toxicity", "quality"):
        got = {r["doc_id"]: r["score"] for r in operators(spark, models)[name](odd(spark)).collect()}
        assert all(abs(got[i] - got[i + len(ODD)]) < 1e-6 for i in range(len(ODD)))


def test_filters_keep_columns_as_they_are(spark, models):
    df = odd(spark)
    kept = quality.keep(df, models[1])
    assert kept.dtypes == df.dtypes
    found = secrets.secrets(df.drop("found"), redact="#")
    assert found.drop("found").dtypes == df.drop("found").dtypes


def test_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (3, "u", "<p>words of a page</p>"), (3, "u", "<p>words of a page</p>"), (4, "u", "<p>" * 3000 + "x " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "n_chars": F.lit("own"), "odd name.x": F.lit(1)})
    out = html.article_text(df).collect()
    assert sorted(r["n_chars"] for r in out) == [0, 0, 15, 15, 39_999] and out[0]["odd name.x"] == 1
    assert html.article_text(df.limit(0)).collect() == []


def test_notices(spark):
    df = odd(spark).union(odd(spark).limit(1).withColumn("text", F.lit("Released under the MIT License.")).withColumn("doc_id", F.lit(None).cast("long")).select(odd(spark).columns))
    assert [(r["doc_id"], r["license"]) for r in licenses.license_blocks(df).collect()] == [(None, "MIT")]
    assert licenses.license_blocks(df.limit(0)).collect() == []


def test_vectors_of_one_row(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").withColumns({"links": F.lit(1), "n": F.lit(1), "v": F.lit("own")})
    assert [tuple(r) for r in vectors.near_duplicates(df).collect()] == [(7, 0, 7, True)]


def test_models_without_labels(spark):
    df, none = odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.apply(df, toxicity.fit(df, none)).collect()} == {0}
    assert quality.apply(df, quality.fit(df, none, 0.7)).where("score <> round(score, 9)").count() >= 0
