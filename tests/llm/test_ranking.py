"""Quality is learned from all labelled rows and all pairs of them, in memory and by passes over stored blocks alike."""

import random

import numpy as np
import pytest

from sparkmask.llm import quality, ranking


def table(spark, n):
    """Documents and labels; good texts are of words, bad ones of symbols too, some of either kind are like the other."""
    rnd = random.Random(5)
    texts, marks = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["river", "stone", "Grass", "and", "the", f"{i}"] * rnd.randint(1, 4)
        rnd.shuffle(words)
        texts.append((i, " ".join(w + ("" if good != (rnd.random() < 0.05) else rnd.choice(["#", "$$", "&!"])) for w in words)))
        marks.append((i, int(good)))
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int"), texts, marks


def rows_of(texts, marks):
    """What is learned from, in one array: whole texts, then excerpts of good ones."""
    good = [(i, t) for (i, t), (_, y) in zip(texts, marks, strict=True) if y]
    x = np.concatenate([quality.features([t for _, t in texts]), quality.features([quality.excerpt(t, quality.zlib.crc32(str(i).encode())) for i, t in good])])
    return x, np.array([y for _, y in marks] + [1] * len(good)), np.arange(len(x)) < len(texts)


def test_quality_learns_from_every_labelled_row(spark):
    documents, labels, texts, marks = table(spark, 9_000)
    model = quality.fit(documents, labels, 0.7)
    x, _, _ = rows_of(texts, marks)
    ordered = np.sort(x, axis=0)
    assert np.array_equal(model["knots"], ordered[np.ceil(np.array([0.05, 0.25, 0.75, 0.95]) * len(x)).astype(int) - 1])
    assert np.allclose(model["mean"], quality.expand(x, model["knots"]).mean(0), atol=1e-12)


def test_weights_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    y = (np.arange(300) % 4 > 0).astype(int)
    x = np.abs(rng.normal(0.1, 0.05, (300, quality._WIDTH)))
    x[:, 3] += 0.1 * y
    model = quality.train(x, y, 0.7)
    z = quality.standard(model, x)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    loss = lambda w: np.mean(np.logaddexp(0, -diff @ w)) + quality.DECAY / 2 * (w @ w)
    assert np.abs(quality.gradient(model["w"], diff)).max() < 1e-5
    assert all(loss(model["w"]) <= loss(model["w"] + rng.normal(0, 0.01, len(model["w"]))) for _ in range(5))
    w = rng.normal(0, 0.3, z.shape[1])
    at = ranking.Scores(ranking.Held([(x[i : i + 70], y[i : i + 70], y[i : i + 70] == 1) for i in range(0, 300, 70)]), lambda x: quality.standard(model, x), w, quality.MOST)
    gradient, second = at.slopes()
    p = 1 / (1 + np.exp(diff @ w))
    assert at.loss == pytest.approx(loss(w) - quality.DECAY / 2 * (w @ w), abs=1e-6)
    assert np.allclose(gradient + quality.DECAY * w, quality.gradient(w, diff), atol=1e-6)
    assert np.allclose(second, (diff * (p * (1 - p))[:, None]).T @ diff / len(diff), atol=0.01)


def test_cut_is_in_the_widest_gap_of_all_scores():
    rng = np.random.default_rng(4)
    y = (rng.random(2_000) < 0.8).astype(int)
    x = np.abs(rng.normal(0.1, 0.05, (2_000, quality._WIDTH)))
    x[:, 5] += 0.2 * y
    model = quality.train(x, y, 0.7)
    s = np.sort(quality.standard(model, x) @ model["w"])
    low, high = np.quantile(s, [np.mean(y == 0) - 0.03, np.mean(y == 0) + 0.03])
    near = s[(s >= low) & (s <= high)]
    k = np.diff(near).argmax()
    assert model["cut"] == pytest.approx((near[k] + near[k + 1]) / 2, abs=1e-9) and model["slope"] == pytest.approx(4 / s.std(), rel=1e-6)


def test_stored_blocks_teach_what_held_ones_do(spark, monkeypatch):
    documents, labels, texts, marks = table(spark, 700)
    odd = spark.createDataFrame([(None, "no id"), (800, None), (801, "no label"), (3, "a repeated id"), (802, "")], "doc_id long, text string")
    documents, labels = documents.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1), (800, 1), (802, 0), (801, None), (5, 7)], "doc_id long, quality int"))
    texts, marks = texts + [(3, "a repeated id"), (802, "")], marks + [(3, marks[3][1]), (802, 0)]
    given = quality.train(*rows_of(texts, marks)[:2], 0.7, rows_of(texts, marks)[2])
    monkeypatch.setattr(quality, "HELD_ROWS", 0)
    monkeypatch.setattr(quality.measured, "__defaults__", (0,))  # no broadcast: labels are joined by shuffle
    model = quality.fit(documents, labels, 0.7)
    assert np.array_equal(model["knots"], given["knots"])
    for name in ("mean", "scale", "w", "cut", "slope"):
        assert np.allclose(model[name], given[name], atol=1e-7), name


def test_order_statistics_and_gaps(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (900, 2)) * 10.0 ** rng.integers(-9, 9, (900, 1)), np.zeros((60, 2)), -np.zeros((9, 2)), np.full((30, 2), -1.5)])
    blocks = [(x[i : i + 100], np.zeros(len(x[i : i + 100])), np.ones(len(x[i : i + 100]), bool)) for i in range(0, len(x), 100)]
    stored = spark.createDataFrame(x.tolist(), "a double, b double").repartition(5)

    def unpack(batches):
        for b in batches:
            yield np.stack([c.to_numpy() for c in b.columns], axis=1), np.zeros(b.num_rows), np.ones(b.num_rows, bool)

    ranks = np.array([[0, 1, 400, 500, 998], [7, 998, 997, 3, 450]])
    for source in (ranking.Held(blocks), ranking.Stored(stored, unpack)):
        assert np.array_equal(ranking.order_statistics(source, lambda x, y, whole: x, ranks), np.sort(x, axis=0).T[[[0], [1]], ranks])
        first = lambda x, y, whole: x[:, :1]
        assert np.allclose(ranking.quantiles(source, first, len(x), [0, 0.3, 0.62, 1]), np.quantile(x[:, 0], [0, 0.3, 0.62, 1]))
        near = np.sort(x[np.abs(x[:, 0]) <= 2, 0])
        k = np.diff(near).argmax()
        assert source.widest(first, -2, 2) == (near[k], near[k + 1])
        assert source.widest(first, -1.5, -1.5) is None and source.widest(first, 3e99, 4e99) is None
