"""Benchmark decontamination: a prefix-filtered set join of document words with benchmark windows.

A window occurs only where all its shingles do, so one shingle is a necessary prefix: the one that the corpus holds
least often.  A first scan counts the benchmark's shingles in all documents; a second joins the rare ones, keeps the
places where the whole window fits between the bounds of the text, and compares all words there.

A benchmark of up to BLOCK_CHARS characters is carried to the tasks, and rows stay where they are.  A larger one stays
distributed: documents send the shingles that a bitmap of bounded size lets through, with the words around them, to a
join with the windows.  Both give the same rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column

from .common import chunks, cut, dealt_anew, pieces, small_batches
from .textops import ALNUM, U64, Words, constants, mix

SHINGLE = 3
CHUNK = 1 << 18
#: Characters of benchmark text that are carried to the tasks at most.
BLOCK_CHARS = 2_000_000
#: Bits of the bitmap that shingles are tested by, at most, and bits for each shingle below that.
BITMAP_BITS, BITS_EACH = 1 << 27, 16


class Windows:
    """All windows of some benchmark items, their words' hashes and their shingles."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        w = Words([t for _, t in items], ALNUM)
        self.names = [str(i) for i, _ in items]
        many = np.where(w.count >= width, w.count - width + 1, (w.count > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(items)), many)
        start = w.first[self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(many) - many, many)
        self.length = np.minimum(width, w.count[self.item])
        place = np.minimum(start[:, None] + np.arange(width), max(0, len(w.hash) - 1))
        self.words = w.hash[place] if len(w.hash) else np.zeros((0, width), U64)
        self.size = np.minimum(SHINGLE, self.length)
        self.sizes = sorted(set(self.size.tolist()))
        owner, offset, token = [], [], []
        for k in self.sizes:
            at = np.flatnonzero(self.size == k)
            for o in range(width - k + 1):
                fits = at[self.length[at] >= o + k]
                owner.append(fits)
                offset.append(np.full(len(fits), o))
                token.append(_shingle(self.words[fits, o : o + k], k))
        self.owner, self.offset, self.token = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owner, np.int64), (offset, np.int64), (token, U64)))

    def prefixes(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, first, window, offset): windows by their rarest shingle, ties to the smaller hash and offset."""
        often = np.array([counts.get(t, 0) for t in self.token.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.offset, self.token, often, self.owner))
        first = np.flatnonzero(np.concatenate([[True], self.owner[order][1:] != self.owner[order][:-1]])) if len(order) else order
        chosen = order[first]
        chosen = chosen[(often[chosen] > 0)]  # a shingle that no document holds leaves nothing to look for
        chosen = chosen[np.argsort(self.token[chosen], kind="stable")]
        token, first = np.unique(self.token[chosen], return_index=True)
        return token, np.append(first, len(chosen)), self.owner[chosen], self.offset[chosen]


def _shingle(words: np.ndarray, k: int) -> np.ndarray:
    """The same hashes as Words.shingles gives."""
    with np.errstate(over="ignore"):
        return mix((words * constants(k, 23)).sum(axis=1, dtype=U64) + U64(k))


def _runs(w: Words, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, document, word index) of the shingles of each size; texts of fewer words have none."""
    for k in sizes:
        h, doc, at = w.shingles(k)
        if k > 1 and (short := (w.count > 0) & (w.count < k)).any():  # such texts gave one shorter run
            keep = np.ones(len(h), bool)
            keep[np.searchsorted(doc, np.arange(len(w.count)), "left")[short]] = False
            h, doc, at = h[keep], doc[keep], at[keep]
        yield h, doc, at


def _places(w: Words, sizes: list[int], tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index in the sorted tokens, word index, document) wherever a text holds a token."""
    for h, doc, at in _runs(w, sizes):
        if len(tokens) and len(h):
            i = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
            hit = np.flatnonzero(tokens[i] == h)
            yield i[hit], at[hit], doc[hit]


def _occurrences(w: Words, windows: Windows, prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, word index, document) of every window in every text."""
    tokens, first, window, offset = prefixes
    found = [(np.zeros(0, np.int64),) * 3]
    for i, at, doc in _places(w, windows.sizes, tokens):
        n = first[i + 1] - first[i]
        pick = np.repeat(first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        win, d = window[pick], np.repeat(doc, n)
        start = np.repeat(at, n) - offset[pick]
        length = windows.length[win]
        fits = (start >= w.first[d]) & (start + length <= w.first[d + 1])
        win, d, start = win[fits], d[fits], start[fits]
        for s in range(0, len(win), 1 << 16):
            v, b, c = win[s : s + (1 << 16)], start[s : s + (1 << 16)], d[s : s + (1 << 16)]
            width = np.arange(windows.words.shape[1])
            same = w.hash[np.minimum(b[:, None] + width, len(w.hash) - 1)] == windows.words[v]
            ok = np.all(same | (width >= windows.length[v][:, None]), axis=1)
            found.append((v[ok], b[ok], c[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _frequencies(documents: DataFrame, text_col: str, windows: Windows) -> dict[int, int]:
    """How often all documents together hold each of the windows' shingles."""
    tokens, sizes = np.unique(windows.token), windows.sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            for i, j in chunks([len(t or "") for t in texts], CHUNK):
                for index, _, _ in _places(Words(texts[i:j], ALNUM), sizes, tokens):
                    total += np.bincount(index, minlength=len(tokens))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(tokens[at].view(np.int64)), pa.array(total[at])], ["token", "n"])

    counted = documents.select(column(text_col).alias("text")).mapInArrow(count, "token long, n long")
    with small_batches(documents.sparkSession):
        rows = counted.groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the block has shingles at most
    return dict(zip(rows["token"].to_pylist(), rows["n"].to_pylist(), strict=True))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, ranges) of every document row.

    A word is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  An item of at least `width`
    words has a window at each of its words that leaves room; a shorter item that has words is one window.  n_hit
    counts the words inside any occurrence of a window, items are the ids (as strings, sorted) with an occurrence, and
    ranges are the hit runs of words as [first, end) pairs, flat.  Null and empty texts have no words.  Words are
    compared by 64-bit hashes, all words of a window each.  Repeated ids and repeated rows are rows of their own.
    """
    items = benchmark.where(column(item_text_col).isNotNull()).select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), column(item_text_col).alias("text"))
    given = documents.select(column(id_col).alias("id"), column(text_col).alias("text"))
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK_CHARS:
        return _joined(given, items, width).withColumnRenamed("id", id_col)
    windows = Windows([(r["item"], r["text"]) for r in items.toArrow().to_pylist()], width)  # BLOCK_CHARS characters at most
    prefixes = windows.prefixes(_frequencies(documents, text_col, windows))
    windows.owner = windows.offset = windows.token = None  # tasks need them no more
    found = given.mapInArrow(_finder(windows, prefixes), f"id {dict(given.dtypes)['id']}, n_words long, items array<string>, ranges array<long>")
    pairs = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, x: x - s)  # alternating: ends minus starts
    return found.select(F.col("id").alias(id_col), "n_words", pairs.alias("n_hit"), "items", "ranges")


def _bitmap(tokens: DataFrame):
    """A broadcast bitmap of 64-bit hashes, of BITMAP_BITS at most: a hash whose bit isn't set is none of them."""
    many = tokens.count()
    bits = 1 << min(BITMAP_BITS.bit_length() - 1, max(16, (many * BITS_EACH).bit_length()))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << 16, np.uint8)
        part[pdf["slot"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "packed": [np.packbits(part, bitorder="little").tobytes()]})

    slots = tokens.select(F.col("token").bitwiseAND(F.lit(bits - 1)).alias("slot")).withColumn("part", F.shiftright("slot", 16))
    rows = slots.groupBy("part").applyInPandas(pack, "part long, packed binary").toArrow().to_pylist()
    whole = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for r in rows:
        whole[r["part"]] = np.frombuffer(r["packed"], np.uint8)
    return tokens.sparkSession.sparkContext.broadcast(whole.ravel())


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes whose bit is set."""
    slot = (hashes & U64(len(bitmap) * 8 - 1)).astype(np.int64)
    return np.flatnonzero((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)


def _joined(given: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """`contamination` of (id, text) by joins, for a benchmark of any size."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Windows(list(zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True)), width)
            order = np.lexsort((w.offset, w.owner))
            first = np.searchsorted(w.owner[order], np.arange(len(w.item) + 1)).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(first), pa.array(w.token[order].view(np.int64)))
            words = pa.array([row[:n].tobytes() for row, n in zip(w.words, w.length, strict=True)], pa.binary())
            yield pa.record_batch([pa.array([w.names[i] for i in w.item], pa.string()), words, tokens], ["item", "words", "tokens"])

    windows = cut(items.mapInArrow(cut_up, "item string, words binary, tokens array<long>"))
    distinct = cut(windows.groupBy("words").agg(F.any_value("tokens").alias("tokens")))
    sizes = [r[0] for r in distinct.select(F.least(F.octet_length("words") / 8, F.lit(SHINGLE)).cast("int")).distinct().collect()]  # SHINGLE rows at most
    tokens = cut(distinct.select(F.explode("tokens").alias("token")).distinct())
    every = _bitmap(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            for i, j in chunks([len(t or "") for t in texts], CHUNK):
                found = [h[_set(every.value, h)] for h, _, _ in _runs(Words(texts[i:j], ALNUM), sizes)]
                h, n = np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    counts = given.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    places = distinct.select("words", F.posexplode("tokens").alias("offset", "token")).join(counts, "token")
    rarest = places.groupBy("words").agg(F.min(F.struct("n", "token", "offset")).alias("best"), F.count("*").alias("known"))
    # a window with a shingle that no document holds occurs nowhere
    rarest = rarest.join(distinct.select("words", F.size("tokens").alias("all")), "words").where("known = all")
    prefix = cut(rarest.select("words", "best.token", "best.offset"))
    rare = _bitmap(prefix.select("token").distinct())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, counted, hits = b.column("text").to_pylist(), [], [[] for _ in range(b.num_rows)]
            for i, j in chunks([len(t or "") for t in texts], CHUNK):
                w = Words(texts[i:j], ALNUM)
                counted += w.count.tolist()
                for h, doc, at in _runs(w, sizes):
                    for x in _set(rare.value, h):
                        d, p = int(doc[x]), int(at[x])
                        low, high = max(int(w.first[d]), p - width + 1), min(int(w.first[d + 1]), p + width)
                        hits[i + d].append({"token": int(h[x].view(np.int64)), "at": p - int(w.first[d]), "before": p - low, "context": w.hash[low:high].tobytes()})
            kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int64()), ("context", pa.binary())]))
            yield pa.record_batch([b.column("id"), pa.array(counted, pa.int64()), pa.array(hits, kind)], ["id", "n_words", "hits"])

    shape = f"id {dict(given.dtypes)['id']}, n_words long, hits array<struct<token:long,at:long,before:long,context:binary>>"
    rows = cut(given.mapInArrow(find, shape).withColumn("row", F.monotonically_increasing_id()))
    near = rows.select("row", "n_words", F.inline("hits")).join(dealt_anew(prefix), "token")
    length, start = (F.octet_length("words") / 8).cast("long"), F.col("at") - F.col("offset")
    fits = (F.col("offset") <= F.col("before")) & (start + length <= F.col("n_words"))
    same = F.substring(F.col("context"), ((F.col("before") - F.col("offset")) * 8 + 1).cast("int"), F.octet_length("words")) == F.col("words")
    found = cut(near.where(fits & same).select("row", "words", start.alias("start"), (start + length).alias("end")))
    named = found.select("row", "words").distinct().join(windows.select("words", "item").distinct(), "words")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("row", "start", "end").distinct().withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    hit = runs.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    out = rows.drop("hits").join(hit, "row", "left").join(named, "row", "left")
    ranges = F.coalesce(F.flatten(F.transform("runs", lambda r: F.array(r["start"], r["end"]))), F.array().cast("array<long>"))
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ranges.alias("ranges"))


def _finder(windows: Windows, prefixes):
    """The items and hit words of rows (id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, counts = b.column("text").to_pylist(), []
            items, ranges = [[] for _ in texts], [[] for _ in texts]
            for i, j in chunks([len(t or "") for t in texts], CHUNK):
                w = Words(texts[i:j], ALNUM)
                counts.extend(w.count.tolist())
                window, start, doc = _occurrences(w, windows, prefixes)
                if not len(window):
                    continue
                pairs = np.unique(np.column_stack([doc, windows.item[window]]), axis=0)
                for d, item in pairs.tolist():
                    items[i + d].append(windows.names[item])
                for d in np.unique(doc).tolist():
                    mine = doc == d
                    s = start[mine] - w.first[d]
                    ranges[i + d] = _merged(s, s + windows.length[window[mine]], int(w.count[d]))
            items = [sorted(set(x)) for x in items]
            yield pa.record_batch([b.column("id"), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.int64()))], ["id", "n_words", "items", "ranges"])

    return find


def _merged(start: np.ndarray, end: np.ndarray, n: int) -> list[int]:
    """The union of runs, as flat [first, end) pairs."""
    depth = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)) > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], depth, [False]]).astype(np.int8))).tolist()
