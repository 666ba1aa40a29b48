"""MinHash near-dedup with odd sketches.

Every document gets MinHash samples of its shingle set; bands of them name buckets, and the samples are folded into a
parity bitmap (an odd sketch).  Two bitmaps' XOR has at most two set bits for each sample that differs, so its
population count bounds the similarity of the pair; pairs that survive are confirmed on their full sets.

No bucket is expanded into its pairs.  First equal sets become one representative.  Then each bucket compares its
members with its best connected one, which settles every bucket whose members end up in one component.  What is left is
compared in blocks of bounded size, across components alone: sketches first, the full sets of what they leave open
second, and at most one edge a member and block comes out.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column

from .common import broadcast_if_small, chunks, cut, dealt_anew, pieces
from .components import connected_components, roots
from .textops import U64, Words, constants, mix

SAMPLES = 120
#: Probability with which a pair at the threshold may share no band.
MISS = 1e-6
SKETCH_WORDS = 8  # 512 bits
#: Members of a block whose full sets are compared at once, and blocks whose sketches are.
BLOCK, SKETCH_BLOCKS = 256, 16
#: Ids of documents to be compared in full that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 18
#: Columns of the matrices that sets are compared by.
COLUMNS = 4096

_A = (constants(SAMPLES, 41) & U64(0xFFFFFFFF)).astype(np.uint32)
_B = (constants(SAMPLES, 43) >> U64(32)).astype(np.uint32)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted."""
    for i, j in chunks([len(t or "") for t in texts], CHUNK):
        h, doc, _ = Words(texts[i:j]).shingles(size)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            s = np.sort(h[first[d] : first[d + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def minhash(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set under as many permutations of 32-bit values."""
    x = (hashes >> U64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return least


def band_rows(similarity: float) -> int:
    """The most samples a band that lose a pair at the threshold with a probability below MISS."""
    return max([r for r in range(1, 11) if SAMPLES % r == 0 and (1 - similarity**r) ** (SAMPLES // r) < MISS], default=1)


def bands(samples: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit bucket name for each band of so many samples."""
    by = constants(rows, 47)
    with np.errstate(over="ignore"):
        folded = (samples.reshape(-1, rows).astype(U64) * by).sum(axis=1, dtype=U64)
        return mix(folded ^ constants(len(folded), 53))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples with their places, as SKETCH_WORDS 64-bit words."""
    with np.errstate(over="ignore"):
        bit = mix(samples.astype(U64) + (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(64 * SKETCH_WORDS)
    parity = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def most_odd_bits(similarity: float, miss: float = 1e-9) -> int:
    """XOR bits that a pair of at least this similarity exceeds with probability `miss` at most.

    A sample differs with probability 1 - similarity and flips two bits at most, so this is twice a binomial quantile.
    """
    p = 1 - similarity
    term, total, k = (1 - p) ** SAMPLES, 0.0, 0
    while total + term < 1 - miss and k < SAMPLES:
        total += term
        term *= (SAMPLES - k) / (k + 1) * p / (1 - p)
        k += 1
    return 2 * k


def signatures(documents: DataFrame, id_col: str, text_col: str, size: int, rows: int) -> DataFrame:
    """(id, n, set_a, set_b, bands, sketch); the last four are null for a document without shingles."""
    kind = dict(documents.dtypes)[id_col]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, whole_a, whole_b, names, sketches = [], [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), size):
                n.append(len(s))
                if not len(s):
                    for x in (whole_a, whole_b, names, sketches):
                        x.append(None)
                    continue
                samples = minhash(s)
                with np.errstate(over="ignore"):
                    whole_a.append(int(mix(s).sum(dtype=U64).view(np.int64)))
                    whole_b.append(int(mix(s * U64(3) + U64(1)).sum(dtype=U64).view(np.int64)))
                names.append(bands(samples, rows).view(np.int64))
                sketches.append(odd_sketch(samples).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(whole_a, pa.int64()), pa.array(whole_b, pa.int64()), pa.array(names, longs), pa.array(sketches, longs)], ["id", "n", "set_a", "set_b", "bands", "sketch"])

    given = documents.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return given.mapInArrow(sign, f"id {kind}, n long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _promising(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    most = most_odd_bits(percent / 100)
    left = about.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = about.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    odd = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(left, "a").join(right, "b").where(sizes & (odd <= most)).select("a", "b")


def _confirmed(pairs: DataFrame, documents: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    kind = dict(documents.dtypes)[id_col]
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    full = _sets(documents, ids, id_col, text_col, size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    joined = joined.join(full.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(compare, f"a {kind}, b {kind}")


def _sets(documents: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, set) of the documents with these ids."""
    kind = dict(documents.dtypes)[id_col]
    texts = documents.select(column(id_col).alias("id"), column(text_col).alias("text"))
    texts = texts.join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.record_batch([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), size)], pa.binary())], ["id", "set"])

    return cut(texts.mapInArrow(sets, f"id {kind}, set binary"))


def common_sizes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y, by products of 0/1 matrices in column blocks."""
    sizes = [len(s) for s in (*x, *y)]
    _, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        ones = np.zeros((len(sizes), COLUMNS), np.float32)
        ones[row[part], column[part] - c] = 1
        out += ones[: len(x)] @ ones[len(x) :].T
    return out


def _across(members: DataFrame, documents: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that join what is linked among a bucket's members in different components.

    members: (bucket, id, component, n, sketch).  A bucket of m members is cut into ceil(m / BLOCK) blocks by the ids'
    hash.  First a task compares the sketches of SKETCH_BLOCKS times as many members with as many others, and names the
    members of each pair of blocks that sketches don't tell apart.  Only these members' sets are fetched, and a second
    task confirms a pair of blocks on them, with at most one edge a member.
    """
    most, kind = most_odd_bits(percent / 100), dict(members.dtypes)["id"]
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(dealt_anew(blocks), "bucket").withColumn("part", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("own", (F.col("part") / SKETCH_BLOCKS).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), ((F.col("blocks") - 1) / SKETCH_BLOCKS).cast("int"))))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def may_link(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        sx, sy = (np.array(p["sketch"].tolist(), np.int64).view(U64) for p in (x, y))
        nx, ny, cx, cy = (p[c].to_numpy() for c in ("n", "component") for p in (x, y))
        sy = np.ascontiguousarray(sy.T)
        out = np.stack([np.add.reduce(np.bitwise_count(sy ^ s[:, None]), axis=0, dtype=np.uint16) <= most for s in sx])
        return out & (cx[:, None] != cy) & (100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny))

    columns = ["bucket", "part", "id", "component", "n", "sketch"]

    def open_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["own"] == pdf[c].iloc[0]].sort_values("part") for c in ("low", "high"))
        rows, low, high = [], [], []
        if len(x) and len(y):
            may = may_link(x, y)
            px, py = (p["part"].to_numpy() for p in (x, y))
            for p in np.unique(px):
                i = slice(*np.searchsorted(px, [p, p + 1]))
                for q in np.unique(py[may[i].any(axis=0)]):
                    j = slice(*np.searchsorted(py, [q, q + 1]))
                    if p <= q:
                        one = may[i, j]
                        both = [i.start + np.flatnonzero(one.any(axis=1))] + [len(x) + j.start + np.flatnonzero(one.any(axis=0))] * int(p < q)
                        rows += both
                        low.append(np.full(sum(map(len, both)), p))
                        high.append(np.full(len(low[-1]), q))
        if not rows:
            return pdf.iloc[:0][[*columns, "low", "high"]]
        return pd.concat([x, y])[columns].iloc[np.concatenate(rows)].assign(low=np.concatenate(low), high=np.concatenate(high))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["part"] == pdf[c].iloc[0]] for c in ("low", "high"))
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        may = may_link(x, y)
        nx, ny, cx, cy = (p[c].to_numpy() for c in ("n", "component") for p in (x, y))
        common = common_sizes(*([np.frombuffer(s, U64) for s in p["set"]] for p in (x, y)))
        a, b = np.nonzero(may & (100 * common >= percent * (nx[:, None] + ny - common)))
        ids, at = np.unique(np.concatenate([cx[a], cy[b]]), return_inverse=True)
        root = roots(len(ids), at[: len(a)], at[len(a) :])
        return pd.DataFrame({"a": ids, "b": ids[root]})

    # dealt by bucket and blocks, else all blocks of a bucket would stay in one task
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to compare
    dealt = dealt.select(*columns, "own", "low", "high").repartition(tasks, "bucket", "low", "high")
    shape = f"bucket long, part int, id {kind}, component {kind}, n long, sketch array<long>, low int, high int"
    found = cut(dealt.groupBy("bucket", "low", "high").applyInPandas(open_parts, shape))
    full = _sets(documents, cut(found.select("id").distinct()), id_col, text_col, size)
    found = found.join(full, "id").repartition("bucket", "low", "high")
    return found.groupBy("bucket", "low", "high").applyInPandas(compare, f"a {kind}, b {kind}").where("a <> b")


def _unnamed(documents: DataFrame, id_col: str) -> bool:
    """Whether any id is null or repeated."""
    ids = documents.select(column(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return not ids.where("id is null or n > 1").isEmpty()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document row.

    Documents link when 100 * intersection >= percent * union of their sets of `size`-word shingles; component_id is
    the smallest id that links reach, and one row of each component is kept, the one of that id.  A shorter text is one
    shingle.  Null and empty texts and texts of white space link with nothing.  Ids are integers.  Where some are null or
    repeated, rows are numbered first: a null id is never the smallest unless there is no other, and of rows that share
    the smallest id the first is kept.  Other columns, whatever they are called, take no part.
    """
    if not _unnamed(documents, id_col):
        out = _components(documents, id_col, text_col, size, percent)
        return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)
    rows = cut(documents.select(column(id_col).alias("id"), column(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    out = _firsts(rows, _components(rows, "row", "text", size, percent))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def _firsts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, id, n_shingles, first) of numbered rows, where first is the (unnamed, id, row) that leads a component."""
    found = cut(found.withColumnRenamed("id", "row").join(rows.select("row", "id"), "row"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first"))
    return found.join(dealt_anew(first), "component_id")


def keep(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, the one that near_duplicates keeps, with all its columns."""
    if not _unnamed(documents, id_col):
        copies = _components(documents, id_col, text_col, size, percent).where("id <> component_id").select(F.col("id").alias("_copy"))
        return documents.join(broadcast_if_small(cut(copies), BROADCAST_IDS), column(id_col) == F.col("_copy"), "left_anti")
    number = next(n for n in (f"_row{i}" for i in range(len(documents.columns) + 1)) if n not in documents.columns)
    rows = cut(documents.withColumn(number, F.monotonically_increasing_id()))
    plain = rows.select(F.col(number).alias("row"), column(id_col).alias("id"), column(text_col).alias("text"))
    copies = _firsts(plain, _components(plain, "row", "text", size, percent)).where("row <> first.row").select(F.col("row").alias("_copy"))
    return rows.join(broadcast_if_small(cut(copies), BROADCAST_IDS), F.col(number) == F.col("_copy"), "left_anti").drop(number)


def _components(documents: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, n_shingles, component_id) of documents whose ids are unique and not null."""
    signed = cut(signatures(documents, id_col, text_col, size, band_rows(percent / 100)))
    sets = signed.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("first"))
    sets = cut(sets)
    chosen = cut(signed.join(sets.select(F.col("first").alias("id")), "id", "left_semi").select("id", "n", "bands", "sketch"))
    rows = chosen.select("id", F.posexplode("bands").alias("band", "name")).select("id", F.xxhash64("band", "name").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    rows = cut(rows.join(dealt_anew(buckets), "bucket"))
    # the member with the most company leads: the text that copies were made from is near more of them than they are
    company = rows.groupBy("id").agg(F.sum("members").alias("company"))
    leaders = rows.join(company, "id").groupBy("bucket").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("leader"))
    rows = cut(rows.join(dealt_anew(leaders), "bucket"))
    about = chosen.select("id", "n", "sketch")

    pairs = rows.where("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    edges = cut(_confirmed(_promising(pairs, about, percent), documents, id_col, text_col, size, percent))
    labels = connected_components(edges)

    rest = rows.where("members > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = cut(rest.select("bucket", "id", "component", "leader"))
    # the leader has been compared with all the others; of buckets with the same others one is enough
    other = F.when(F.col("id") != F.col("leader"), F.col("id"))
    about_bucket = rest.groupBy("bucket").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count(other).alias("n"),
        F.sum(F.when(other.isNotNull(), F.xxhash64("id").cast("decimal(20,0)"))).alias("h1"),
        F.sum(F.when(other.isNotNull(), F.hash("id").cast("long"))).alias("h2"),
    )
    open_ = about_bucket.where("low <> high").groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = cut(rest.where("id <> leader").join(dealt_anew(open_), "bucket", "left_semi"))
    if not rest.isEmpty():
        more = cut(_across(rest.join(about, "id"), documents, percent, size, id_col, text_col))
        if not more.isEmpty():
            labels = connected_components(edges.union(more))

    sets = sets.join(labels.withColumnRenamed("id", "first"), "first", "left")
    sets = dealt_anew(sets.select("set_a", "set_b", "n", F.coalesce("component", "first").alias("component")))
    out = signed.select("id", "n", "set_a", "set_b").join(sets, ["set_a", "set_b", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
