"""Quality classifier: Bradley-Terry pairwise ranking over whole-text statistics.

A document's strength is a linear score of its features.  All labelled rows are learned from: the weights are those of
least logistic loss on the feature differences of all pairs (kept, rejected).  The cut is a quantile of all learned
scores; scores map to 0..1 so that the cut lands on `threshold`.
"""

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking
from .common import chunks, cut, numbered, pieces, small_batches
from .textops import Words

#: Labels that are broadcast to the texts, at most; beyond, all texts are measured and join the labels by shuffle.
BROADCAST_ROWS = 1_000_000
#: Labelled rows that the driver learns from in its own memory, at most; beyond, it learns by passes over stored features.
HELD_ROWS = 10_000
#: Labelled rows that a task reads in such a pass, where there are more tasks than cores.
TASK_ROWS = 50_000
DECAY = 2e-3
#: Standardised features are cut off here.
MOST = 8.0
#: Bytes of text that are held as arrays at once; a longer text is held alone.
CHUNK = 1 << 18

_SYMBOLS = b"!#$%&*|.,?\"'()=+-_/:;<>@[]{}~^`\\"
PLAIN = 18  # features before those of single symbols
_WIDTH = PLAIN + len(_SYMBOLS)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of statistics over each whole text; a null or empty text has zeros."""
    out = np.zeros((len(texts), _WIDTH))
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for i, j in chunks(map(len, raw), CHUNK):
        out[i:j] = _features([t or "" for t in texts[i:j]], raw[i:j])
    return out


def _features(texts: list[str], raw: list[bytes]) -> np.ndarray:
    w = Words(texts)
    lengths = w.end - w.start
    out = np.zeros((len(texts), _WIDTH))
    for d, b in enumerate(raw):
        n, words = len(b), slice(w.first[d], w.first[d + 1])
        if not n:
            continue
        count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        hashes, long = w.hash[words], lengths[words]
        k = len(hashes)
        # nothing that grows with the length alone: long and short texts are of either kind
        out[d, 0:5] = np.array([count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum(), count[32]]) / n
        out[d, 5] = 20 * count[10] / n
        out[d, 6] = (count[:9].sum() + count[14:32].sum() + count[127]) / n
        lines = b.split(b"\n")
        out[d, 7] = len(set(lines)) / len(lines)
        out[d, PLAIN:] = np.minimum(1, 8 * count[np.frombuffer(_SYMBOLS, np.uint8)] / n)
        if k:
            ordered = np.sort(hashes)
            runs = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
            out[d, 8:14] = long.mean() / 10, long.std() / 10, (long <= 2).mean(), (long >= 12).mean(), len(runs) / k, runs.max() / k
            out[d, 14] = (hashes[1:] == hashes[:-1]).mean() if k > 1 else 0
            lagged = hashes[1:] ^ (hashes[:-1] << np.uint64(1))
            out[d, 15] = len(np.unique(lagged)) / max(1, k - 1)
            out[d, 16] = k < 20
            out[d, 17] = k < 60
    return out


def excerpt(text: str, key: int) -> str:
    """Up to 40 words from somewhere in a text, by key: training also sees how short good texts look."""
    words = text.split(" ")
    n, at = 1 + key % 40, key // 40 % max(1, len(words))
    return " ".join(words[at : at + n])


def expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Features and their hinges beyond each knot, so that a linear score can bend."""
    return np.concatenate([x, *(np.maximum(0, x - k) for k in knots)], axis=1)


def gradient(w: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Of the mean of log(1 + exp(-diff @ w)) over pairs, plus DECAY / 2 times the square of w."""
    lost = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
    return -(diff * lost[:, None]).mean(0) + DECAY * w


def standard(model: dict, x: np.ndarray) -> np.ndarray:
    """What weights are for: features and their hinges, by their means and deviations."""
    return np.clip((expand(x, model["knots"]) - model["mean"]) / model["scale"], -MOST, MOST)


def train(x: np.ndarray, y: np.ndarray, threshold: float, whole: np.ndarray | None = None) -> dict:
    """`learn` from rows in memory, all of them whole texts by default."""
    whole = np.ones(len(x), bool) if whole is None else whole
    return learn(ranking.Held([(x[i : i + 1024], y[i : i + 1024], whole[i : i + 1024]) for i in range(0, len(x), 1024)]), threshold)


def learn(source: ranking.Held | ranking.Stored, threshold: float) -> dict:
    """Weights of least logistic loss on all pairs; cut at the quantile of scores that the labels' balance gives.

    Knots, means, deviations, weights and the cut are those of all rows.  The cut goes by the rows marked whole: excerpts
    only widen what is known as good.  Without rows of both labels nothing can be ranked: all weights are then 0 and every
    document gets `threshold`.
    """
    width = 5 * _WIDTH
    model = {"knots": np.zeros((4, _WIDTH)), "mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(width), "cut": 0.0, "slope": 1.0, "threshold": threshold}

    def count(out, x, y, whole):
        out += np.bincount((y == 1) + 2 * whole.astype(np.int64), minlength=4)

    def moments(out, x, y, whole):
        z = expand(x, model["knots"])
        out += np.concatenate([z.sum(0), (z * z).sum(0)])

    counts = source.total(count, 4)
    labels = counts[:2] + counts[2:]
    n = int(labels.sum())
    if not n:
        return model
    ranks = np.ceil(np.array([0.05, 0.25, 0.75, 0.95]) * n).astype(int) - 1
    model["knots"] = ranking.order_statistics(source, lambda x, y, whole: x, np.tile(ranks, (_WIDTH, 1))).T
    mean, square = source.total(moments, 2 * width).reshape(2, width) / n
    scale = np.sqrt(np.maximum(0, square - mean**2))
    model |= {"mean": mean, "scale": np.where(scale < 1e-6, 1.0, scale)}
    if not labels.all():
        return model
    model["w"] = ranking.descend(source, lambda x: standard(model, x), width, DECAY, MOST)

    def scores(x, y, whole):
        return (standard(model, x) @ model["w"])[whole][:, None]

    def spread(out, x, y, whole):
        s = scores(x, y, whole)
        out += s.sum(), (s * s).sum()

    seen, rejected = int(counts[2:].sum()), float(counts[2] / counts[2:].sum())
    low, high, middle = ranking.quantiles(source, scores, seen, [max(0.0, rejected - 0.03), min(1.0, rejected + 0.03), rejected])
    gap = source.widest(scores, low, high)
    model["cut"] = float(sum(gap) / 2 if gap else middle)
    mean, square = source.total(spread, 2) / seen
    model["slope"] = 4.0 / max(1e-6, float(np.sqrt(max(0.0, square - mean**2))))
    return model


def score(model: dict, texts: list[str | None]) -> np.ndarray:
    """0 to 1, rising with the learned strength; the quantile cut gives exactly `threshold`."""
    z, t = standard(model, features(texts)), model["threshold"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (z @ model["w"] - model["cut"]) + np.log(t / (1 - t)), -30, 30)))


def measured(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(y, whole, part): of every labelled row the features of the whole text and of an excerpt, as bytes."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    if chosen.limit(broadcast_rows + 1).count() <= broadcast_rows:
        chosen = F.broadcast(chosen)
        texts = texts.join(chosen, "id", "left_semi")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            parts = [excerpt(t, zlib.crc32(str(k).encode())) for k, t in zip(b.column("id").to_pylist(), texts, strict=True)]
            x = [pa.array([row.tobytes() for row in features(given)], pa.binary()) for given in (texts, parts)]
            yield pa.record_batch([b.column("id"), *x], ["id", "whole", "part"])

    # one function for Python in a stage, as each has a process of its own in every task
    kind = dict(documents.dtypes)[id_col]
    return texts.mapInArrow(measure, f"id {kind}, whole binary, part binary").join(chosen, "id").select("y", "whole", "part")


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What is learned from rows of `measured`: all whole texts, and excerpts of good ones."""
    for b in pieces(batches, rows=256):
        y = b.column("y").to_numpy()
        whole, part = (np.frombuffer(b"".join(b.column(c).to_pylist())).reshape(-1, _WIDTH) for c in ("whole", "part"))
        good = y == 1
        yield np.concatenate([whole, part[good]]), np.concatenate([y, y[good]]), np.arange(len(y) + good.sum()) < len(y)


def fit(documents: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Train on all labelled rows, each as a whole text, and good ones as a short excerpt too.

    Rows with a null id, a null text or a label other than 0 and 1 don't take part.
    """
    rows = cut(measured(documents, labels, id_col, text_col, label_col))
    n = rows.count()
    if n <= HELD_ROWS:
        with small_batches(documents.sparkSession):
            return learn(ranking.Held(list(blocks(rows.toArrow().to_batches()))), threshold)
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    return learn(ranking.Stored(rows.coalesce(tasks), blocks), threshold)


def apply(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document row from its whole text; null and empty texts have the features of nothing.

    A row with a null or repeated id is a row of the result; other columns, whatever they are called, take no part.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = score(model, b.column("text").to_pylist())
            yield pa.record_batch([b.column("id"), pa.array(s, pa.float64()), pa.array((s >= model["threshold"]).astype(np.int32))], ["id", "score", "predicted"])

    kind = dict(documents.dtypes)[id_col]
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rate, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep(documents: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows that reach the threshold, with all their columns, whatever they are called.

    Rows are judged by their own texts, whether their ids are null, repeated or not; a null text is judged as an empty one.
    """
    at = documents.columns.index(text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = score(model, b.column(at).to_pylist())
            yield b.filter(pa.array(s >= model["threshold"]))

    given = numbered(documents)
    return given.mapInArrow(rate, given.schema).toDF(*documents.columns)
