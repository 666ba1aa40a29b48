"""Embedding near-dedup by int8 tile products with error bounds.

Unit vectors are rounded to int8 with a scale of their own, and the length of what rounding lost is kept.  For unit x, y
with codes p, q, scales s, t and losses d, e:  |x.y - s t p.q| <= d + (1 + d) e.  Tiles of codes are multiplied, and only
pairs whose bound reaches the threshold are computed again in double precision.

Only vectors of one label and length are compared.  Equal vectors become one with a multiplicity.  Large labels are cut
into cells around pivots; a vector visits another cell only if a linked vector could live there, by the distance to the
plane between two pivots.  Cells that are still large are compared in tiles.  Vectors are rounded once, and tiles get
codes alone; whole vectors are fetched only for those that have an open pair in a tile.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column

from .common import cut, dealt_anew, pieces
from .components import connected_components, roots

#: Rows of a tile.
TILE = 2048
#: Pivots of a label at most, and bytes of all labels' pivots together; the largest labels come first.  They are
#: broadcast, so they don't grow with the data; larger cells are tiled.
PIVOTS, PIVOT_BYTES = 64, 16 << 20
#: Labels that get pivots at most.
PIVOT_LABELS = 1024
#: Products of up to so many codes are whole numbers that float32 holds exactly (127 * 127 * 1040 < 2**24).
EXACT = 1040


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows in double precision, norms)."""
    x = np.array(vectors, np.float64)
    peak = np.abs(x).max(axis=1, keepdims=True)
    x = x / peak  # squares of very small or large numbers stay finite
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / norm, norm


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, lengths of the loss) of rows; the lengths are rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scale, lost


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of code rows, by float32 multiplication of column blocks."""
    out = np.zeros((len(p), len(q)))
    for i in range(0, p.shape[1], EXACT):
        out += p[:, i : i + EXACT].astype(np.float32) @ q[:, i : i + EXACT].astype(np.float32).T
    return out


def bounds(p, s, d, q, t, e) -> np.ndarray:
    """The greatest cosine that each pair of rows with codes, scales and losses can have."""
    return products(p, q) * (s[:, None] * t[None, :]) + (d[:, None] + (1 + d[:, None]) * e[None, :])


def linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit rows with cosine of at least `least`."""
    i, j = np.nonzero(bounds(*quantise(x), *quantise(y)) >= least - 1e-12)
    keep = []
    for k in range(0, len(i), 1 << 16):
        keep.append(np.einsum("ij,ij->i", x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]) >= least)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector row.

    Vectors link when their labels are equal and not null, they have the same length, and their cosine in double
    precision is at least `least` (above 0).  Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing.  Ids are integers; component_id is the smallest that links reach, and one row of each component is
    kept, the one of that id.  A null id is never the smallest unless there is no other, and of rows that share the
    smallest id one is kept.  Each row goes by its own vector; other columns, whatever they are called, take no part.
    """
    kind, label = dict(vectors.dtypes)[id_col], dict(vectors.dtypes)[label_col]
    number = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # computed in double precision either way
    given = vectors.select(column(id_col).alias("id"), column(label_col).alias("label"), column(vector_col).cast(f"array<{number}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.transform("v", lambda x: x + F.lit(0.0).cast(number))  # -0.0 equals 0.0
    good = given.where(usable).withColumn("row", F.monotonically_increasing_id())
    good = good.select("id", "row", "label", F.size("v").alias("dim"), key.alias("v"))
    # equal vectors are told by 128 bits of hash, so that joins of rows with their class move no vectors
    hashes = [F.xxhash64(F.lit(seed), "v").alias(f"h{seed}") for seed in (1, 2)]
    good = cut(good.select("*", *hashes))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first")
    same = ["label", "dim", "h1", "h2"]
    classes = good.groupBy(*same).agg(first, F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))

    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes))
    reach = np.sqrt(max(0.0, 2 - 2 * least))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows=4096):
            labels, dims, values = (b.column(c).to_pylist() for c in ("label", "dim", "v"))
            rows, cells, homes = [], [], []
            codes, scale, lost = [b""] * len(values), np.zeros(len(values)), np.zeros(len(values))
            by: dict[tuple, list[int]] = {}
            for k, g in enumerate(zip(labels, dims, strict=True)):
                by.setdefault(g, []).append(k)
            for g, at in by.items():
                x, at = unit([values[k] for k in at])[0], np.array(at)
                p, scale[at], lost[at] = quantise(x)
                for k, c in zip(at, p, strict=True):
                    codes[k] = c.tobytes()
                centre = pivots.value.get(g)
                home = np.zeros(len(at), int)
                if centre is not None:
                    dots = x @ centre.T
                    home = dots.argmax(axis=1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T)) + 1e-9
                    plane = (dots[np.arange(len(at)), home][:, None] - dots) / apart[home]
                    k, c = np.nonzero((plane <= reach + 1e-6) & (np.arange(len(centre)) < home[:, None]))
                    rows, cells, homes = [*rows, at[k]], [*cells, c], [*homes, np.zeros(len(k), bool)]
                rows, cells, homes = [*rows, at], [*cells, home], [*homes, np.ones(len(at), bool)]
            about = pa.record_batch([b.column("class"), b.column("label"), b.column("dim"), pa.array(codes, pa.binary()), pa.array(scale), pa.array(lost)], names[:6])
            about = about.take(pa.array(np.concatenate(rows)))
            yield pa.record_batch([*about.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(homes))], names)

    names = ["class", "label", "dim", "codes", "scale", "lost", "cell", "home"]
    schema = f"class long, label {label}, dim int, codes binary, scale double, lost double, cell int, home boolean"
    placed = cut(classes.select("class", "label", "dim", "v").mapInArrow(place, schema))
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("tiles"), F.ceil(F.count_if(~F.col("home")) / TILE).cast("int").alias("guests"))
    dealt = placed.join(sizes, cell)
    # home tiles are 0..tiles-1, guest tiles follow; a home tile meets the home tiles from its own on and all guest tiles
    own = F.when(F.col("home"), F.pmod(F.xxhash64("class"), F.greatest("tiles", F.lit(1)))).otherwise(F.col("tiles") + F.pmod(F.xxhash64("class"), F.greatest("guests", F.lit(1))))
    dealt = dealt.withColumn("own", own.cast("int"))
    others = F.when(F.col("home"), F.sequence(F.lit(0), F.col("tiles") + F.col("guests") - 1)).when(F.col("tiles") > 0, F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def tiles(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return tuple(pdf[pdf["own"] == pdf[c].iloc[0]] for c in ("low", "high"))

    pair = [*cell, "low", "high"]

    def open_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = tiles(pdf)
        if not len(x) or not len(y):
            return pdf.iloc[:0][[*pair, "own", "class"]]
        coded = [(np.frombuffer(b"".join(t["codes"]), np.int8).reshape(len(t), -1), t["scale"].to_numpy(), t["lost"].to_numpy()) for t in (x, y)]
        may = bounds(*coded[0], *coded[1]) >= least - 1e-12
        if x["own"].iloc[0] == y["own"].iloc[0]:
            np.fill_diagonal(may, False)
            return x[may.any(axis=1)][[*pair, "own", "class"]]
        return pd.concat([x[may.any(axis=1)], y[may.any(axis=0)]])[[*pair, "own", "class"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = tiles(pdf)
        if not len(x) or not len(y):
            return pd.DataFrame({"class": [], "links": [], "root": []})
        i, j = linked(unit(x["v"].tolist())[0], unit(y["v"].tolist())[0], least)
        if x["own"].iloc[0] == y["own"].iloc[0]:
            i, j = i[i < j], j[i < j]
            ids, copies = x["class"].to_numpy(), x["copies"].to_numpy()
        else:
            j = j + len(x)
            ids, copies = np.concatenate([x["class"], y["class"]]), np.concatenate([x["copies"], y["copies"]])
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        at = np.flatnonzero(links)
        order = np.argsort(ids, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(ids))
        root = ids[order[roots(len(ids), rank[i], rank[j])]][rank]
        return pd.DataFrame({"class": ids[at], "links": links[at], "root": root[at]})

    # dealt by cell and tiles, else a cell would stay in one task
    dealt = dealt.select(*pair, "own", "class", "codes", "scale", "lost").repartition(*pair)
    shape = f"label {label}, dim int, cell int, low int, high int, own int, class long"
    open_ = cut(dealt.groupBy(*pair).applyInPandas(open_pairs, shape))
    whole = open_.join(dealt_anew(classes.select("class", "v", "copies")), "class").repartition(*pair)
    found = cut(whole.groupBy(*pair).applyInPandas(compare, "class long, links long, root long"))
    labels = connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    about = classes.drop("v").join(links, "class", "left").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    about = cut(about.select(*same, "component", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    leads = about.groupBy("component").agg(F.min("first").alias("lead"))
    about = about.drop("first").join(dealt_anew(leads), "component")
    members = good.drop("v").join(about, same)
    members = members.select("id", F.col("n_links").cast("long").alias("n_links"), F.col("lead.id").alias("component_id"), (F.col("row") == F.col("lead.row")).alias("kept"))
    rest = given.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return members.unionByName(rest).withColumnRenamed("id", id_col)


def _pivots(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit pivots of the labels that fill more than a tile, PIVOT_BYTES in all at most."""
    groups = classes.groupBy("label", "dim").count().where(F.col("count") > TILE).orderBy(F.desc("count"), "label", "dim").limit(PIVOT_LABELS)
    groups = groups.withColumn("want", F.least(F.ceil(F.col("count") / TILE), F.lit(PIVOTS)).cast("int"))
    room = F.sum(F.col("want") * F.col("dim") * 8).over(Window.orderBy(F.desc("count"), "label", "dim")) <= PIVOT_BYTES  # PIVOT_LABELS rows at most
    groups = groups.withColumn("room", room).where("room").drop("room")
    chance = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < F.col("want") * F.lit(4 << 30) / F.col("count")
    sampled = classes.join(F.broadcast(groups), ["label", "dim"]).where(chance)  # about four for each wanted pivot
    nth = F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("class"), "class"))
    rows = sampled.withColumn("nth", nth).where("nth <= want").select("label", "dim", "v").toArrow().to_pylist()
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r["label"], r["dim"]), []).append(r["v"])
    return {g: unit(v)[0] for g, v in by.items()}
