"""Near duplicates of texts and vectors against all pairs; components; queries against their SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmask.llm import neardup, queries, vectors
from sparkmask.llm.components import connected_components, roots
from tests.conftest import DATA, needs_data
from tests.llm.test_text_operators import ODD, docs
from tests.test_queries import compare


def smallest(n, links):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def plain_near(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [(len(s), c) for s, c in zip(sets, smallest(len(sets), links), strict=True)]


def near_texts(variants=40):
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("aeiou") + str(rnd.randrange(40))
    out = []
    for _ in range(5):
        base = [word() for _ in range(rnd.choice([60, 120, 300]))]
        for _ in range(variants):
            new = base[:]
            for _ in range(rnd.randrange(0, 1 + len(base) // 20)):
                new[rnd.randrange(len(new))] = word()
            out.append(" ".join(new))
        out += [" ".join(base), " ".join(base).upper(), " ".join(base) + " "]
    out += [" ".join(word() for _ in range(rnd.randrange(1, 50))) for _ in range(40)] + ["one two", "One  two", "two one", "solo"]
    rnd.shuffle(out)
    return out + ODD


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, size, percent):
    texts = near_texts()
    out = neardup.near_duplicates(docs(spark, texts).withColumn("component_id", F.lit("clash")), size=size, percent=percent).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in out] == plain_near(texts, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_the_last_comparison_alone_finds_all_links(spark, monkeypatch):
    """All texts in one bucket, cut into small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "SKETCH_BLOCKS", 3)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    texts = near_texts(20)
    rows = []
    for i, s in enumerate(neardup.shingle_sets(texts, 3)):
        if len(s):
            rows.append((1, i, i, len(s), neardup.odd_sketch(neardup.minhash(s)).view(np.int64).tolist()))
    members = spark.createDataFrame(rows, "bucket long, id long, component long, n long, sketch array<long>")
    edges = neardup._across(members, docs(spark, texts), 85, 3, "doc_id", "text")
    assert edges.count() <= len(rows) * (1 + len(rows) // 7)
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == [c for _, c in plain_near(texts, 3, 85)]


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0
    lone = neardup.near_duplicates(docs(spark, ["", None])).collect()
    assert [(r["n_shingles"], r["kept"]) for r in lone] == [(0, True)] * 2


def test_bounds_of_sketches():
    assert neardup.band_rows(0.85) == 5 and neardup.band_rows(0.8) == 4
    rng = np.random.default_rng(2)
    for _ in range(50):
        base = rng.integers(0, 2**63, 400, dtype=np.uint64)
        other = base.copy()
        other[:30] = rng.integers(0, 2**63, 30, dtype=np.uint64)  # 370 / 430
        a, b = (neardup.odd_sketch(neardup.minhash(np.unique(x))) for x in (base, other))
        assert np.bitwise_count(a ^ b).sum() <= neardup.most_odd_bits(0.85)


def test_common_sizes():
    rnd = random.Random(4)
    x, y = ([np.unique(np.array([rnd.randrange(300) for _ in range(rnd.randrange(1, 90))], np.uint64)) for _ in range(n)] for n in (6, 9))
    neardup_columns, neardup.COLUMNS = neardup.COLUMNS, 50
    try:
        assert neardup.common_sizes(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    finally:
        neardup.COLUMNS = neardup_columns


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 330)] + [(5, 5), (400, 400)]
    df = spark.createDataFrame([*links, *links[:10], (None, 3), (3, None)], "a long, b long")
    label = smallest(401, links)
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {v: label[v] for a, b in links if a != b for v in (a, b)}
    assert connected_components(df.limit(0)).count() == 0
    i, j = np.array([x for x, _ in links]), np.array([y for _, y in links])
    assert roots(401, i, j).tolist() == label


# Vectors


def plain_vectors(rows, least=0.98):
    links = []
    for a, (_, v, x) in enumerate(rows):
        for b, (_, w, y) in enumerate(rows[:a]):
            if x is None or x != y or not v or not w or len(v) != len(w) or None in v or None in w:
                continue
            p, q = np.array(v, np.float64), np.array(w, np.float64)
            if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / np.sqrt((p @ p) * (q @ q)) >= least:
                links.append((a, b))
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)).tolist()
    return list(zip(n, smallest(len(rows), links), strict=True))


def vector_rows(n=220, dim=12):
    rng, rows = np.random.default_rng(8), []
    centres = rng.normal(size=(15, dim))
    for i in range(n):
        v = centres[rng.integers(15)] + rng.normal(size=dim) * rng.choice([0, 0.03, 0.08, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 1, 1e-3, 50])], int(rng.integers(3))))
    rows += [(n + k, v, g) for k, (v, g) in enumerate([
        (None, 1), ([], 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([float("inf")] + [1.0] * (dim - 1), 1), ([None] + [1.0] * (dim - 1), 1), (rows[0][1], None), (rows[0][1], None),
        (rows[0][1], rows[0][2]), (rows[0][1], rows[0][2]), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([-x for x in rows[1][1]], rows[1][2]), ([0.0] * (dim - 1) + [1.0], 2), ([-0.0] * (dim - 1) + [1.0], 2),
    ])]
    return rows


@pytest.mark.parametrize("tile", [2048, 16])
def test_vectors_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("id", F.lit("clash"))
    out = vectors.near_duplicates(df).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in out] == plain_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bounds_are_never_exceeded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 40)) * rng.choice([1, 1e-3], size=(300, 40))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    p, s, d = vectors.quantise(x)
    bound = d[:, None] + (1 + d[:, None]) * d
    assert np.all(np.abs(x @ x.T - vectors.products(p, p) * (s[:, None] * s)) <= bound)
    assert np.array_equal(vectors.products(p, p), p.astype(np.int64) @ p.astype(np.int64).T)
    wide = rng.integers(-127, 128, (4, 3000)).astype(np.int8)
    assert np.array_equal(vectors.products(wide, wide), wide.astype(np.int64) @ wide.astype(np.int64).T)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_vectors_of_repeated_ids_are_a_row_each(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (2, "b", [0.0, 1.0]), (3, "a", None), (3, "a", None)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3), (3, 0, 3)]


def test_rows_whose_ids_are_null_or_repeated(spark):
    text, other = "one two three four five six seven", "words of quite another text than this one here"
    rows = [(None, text), (None, text), (7, text), (7, text), (9, text), (None, other), (None, None), (3, None), (3, ""), (None, other)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, row string, id int, `_row0` string")
    out = neardup.near_duplicates(df).collect()
    seen = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out), key=repr)
    expected = [(None, 7, False)] * 2 + [(7, 7, True), (7, 7, False), (9, 7, False), (None, None, True), (None, None, False), (None, None, True), (3, 3, True), (3, 3, True)]
    assert seen == sorted(expected, key=repr)
    kept = neardup.keep(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(7, text), (None, other), (None, None), (3, None), (3, "")], key=repr)


def test_vectors_whose_ids_are_null_or_repeated(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(None, a), (None, a), (7, a), (7, [2.0, 0.001]), (9, a), (None, b), (None, b), (None, None), (3, None), (3, b)]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, row string, class string")
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()), key=repr)
    expected = [(None, 4, 7, False)] * 2 + [(9, 4, 7, False), (None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (None, 0, None, True), (3, 0, 3, True)]
    assert [r for r in out if r[0] != 7] == sorted(expected, key=repr)
    assert sorted(r[3] for r in out if r[0] == 7) == [False, True] and all(r[1:3] == (4, 7) for r in out if r[0] == 7)


def test_nothing_stays_in_the_checkpoint_folder(spark):
    import gc
    import pathlib
    import time

    folder = pathlib.Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    files = lambda: {p for p in folder.rglob("rdd-*") if p.is_dir() and any(p.iterdir())}
    setting = spark.sparkContext._jsc.sc().conf().get("spark.cleaner.referenceTracking.cleanCheckpoints", "false")
    gc.collect()
    before = files()
    assert neardup.near_duplicates(docs(spark, near_texts(4))).count() > 0
    made = files() - before
    assert made
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not made & files():
            break
        time.sleep(0.5)
    assert not made & files()
    assert spark.sparkContext._jsc.sc().conf().get("spark.cleaner.referenceTracking.cleanCheckpoints", "false") == setting


def test_settings_of_the_session_stay(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    neardup.near_duplicates(docs(spark, ["a b c"])).count()
    vectors.near_duplicates(spark.createDataFrame([(7, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count()
    assert [spark.conf.get(n) for n in names] == before
