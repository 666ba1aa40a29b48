"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Tokens are summed over the cells of source x language x topic.  Raking scales the cells until the sums over each
margin meet its target shares, and no cell is asked for more tokens than it has; a document's probability follows from
its cell's weight, and a hash of its id decides.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column

from .common import broadcast_if_small, cut

#: Words that mark a topic, tried in order; a text with none of them has the last topic.
TOPICS = {
    "license": r"(?i)\b(?:licen[sc]ed?|copyright|warranty)\b",
    "contact": r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|\+[0-9][0-9 ().-]{7,}[0-9]",
    "code": r"[=;{}]|[|#&$%*]\s",
    "prose": None,
}
#: Substrings without any of which a topic's pattern can't match; looking for them is cheaper.
NEEDED = {"contact": ("@", "+")}
#: Raking stops where no sum of a margin is further from its target than TOLERANCE (a share of all tokens), and after
#: ROUNDS at the latest, as caps and empty cells can make targets that nothing meets.  It looks every CHECKED rounds.
TOLERANCE, ROUNDS, CHECKED = 1e-6, 60, 5
#: Share of all tokens that the sample aims at.
BUDGET = 0.5
MARGINS = ("source", "lang", "topic")
#: Cells that are raked in one partition, and whose rates are broadcast, at most.
BROADCAST_CELLS = 200_000


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    # every run but the space before the first one becomes one character
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.ltrim(marks, F.lit(" \t\n\v\f\r"))), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The first topic whose pattern a text holds."""
    out = None
    for name, pattern in TOPICS.items():
        if pattern is not None:
            test = text.rlike(pattern)
            if name in NEEDED:
                test = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in NEEDED[name]]) & test
            test = F.coalesce(test, F.lit(False))
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(list(TOPICS)[-1])


def shares(cells: DataFrame, margin: str, wanted: DataFrame | float) -> DataFrame:
    """(key, target) of the margin's values that have tokens; targets add up to 1.

    wanted is a table (key, target), or a number: then targets are in proportion to that power of the tokens, where 0
    evens out and 1 keeps what is.  Values that a table doesn't name share what it leaves of 1, by their tokens; what it
    wants of values without tokens goes to the others in proportion.
    """
    sums = cells.groupBy(F.col(margin).alias("key")).agg(F.sum("tokens").alias("t")).where("t > 0")
    if not isinstance(wanted, DataFrame):
        sums = sums.withColumn("share", F.pow("t", F.lit(float(wanted))))
    else:
        given = cut(wanted.select(F.col("key").alias("_key"), F.col("target").cast("double").alias("named")))
        left = max(0.0, 1 - (given.agg(F.sum("named")).first()[0] or 0.0))
        sums = cut(sums.join(given, F.col("_key").eqNullSafe(F.col("key")), "left"))
        others = sums.where("named is null").agg(F.sum("t")).first()[0] or 1
        sums = sums.withColumn("share", F.coalesce("named", F.lit(left) * F.col("t") / F.lit(others)))
    whole = sums.agg(F.sum("share")).first()[0] or 1.0
    return sums.select("key", (F.col("share") / F.lit(float(whole))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """cells (the margins' columns and tokens) with `weight`: the raked share of all tokens that a cell should have.

    targets: by margin, (key, target) whose targets add up to 1.  With a budget (a share of all tokens) no weight asks
    for more tokens than its cell has: what is cut off goes to the margins' other cells in the next steps.  A cell
    without tokens, or with a key that has no target, gets weight 0.  Only cells are shuffled, of which there are as many
    as margins' values combine, however many documents there are.  `gaps` tells how near the sums came.
    """
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    now = now.withColumn("_cap", F.col("tokens") / F.lit(budget * whole) if budget and whole else F.lit(float("inf")))
    for margin, target in targets.items():
        given = target.select(F.col("key").alias("_key"), F.col("target").alias(f"_target_{margin}"))
        now = now.join(given, F.col("_key").eqNullSafe(F.col(margin)), "left").drop("_key")
    now = cut(now)
    few = now.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    now = now.coalesce(1) if few else now  # few cells are scaled without shuffles
    for k in range(1, rounds + 1):
        for margin in targets:
            total = F.sum("weight").over(Window.partitionBy(margin))
            scaled = F.when(total > 0, F.col("weight") * (F.coalesce(f"_target_{margin}", F.lit(0.0)) / total))
            now = now.withColumn("weight", F.least("_cap", F.coalesce(scaled, F.lit(0.0))))
        if k % CHECKED == 0 or k == rounds:
            now = cut(now)
            now = now.coalesce(1) if few else now
            far = [F.abs(F.sum("weight").over(Window.partitionBy(m)) - F.coalesce(f"_target_{m}", F.lit(0.0))) for m in targets]
            gap = now.select(F.greatest(*far, F.lit(0.0)).alias("gap")).agg(F.max("gap")).first()[0]
            if gap is None or gap <= tolerance:
                break
    return now.select(*cells.columns, "weight")


def gaps(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(margin, key, target, reached) of all margins' values: the shares wanted, and the sums of the raked weights."""
    out = None
    for m, target in targets.items():
        sums = raked.groupBy(F.col(m).alias("_key")).agg(F.sum("weight").alias("reached"))
        one = target.join(sums, F.col("key").eqNullSafe(F.col("_key")), "left")
        one = one.select(F.lit(m).alias("margin"), F.col("key").cast("string").alias("key"), "target", F.coalesce("reached", F.lit(0.0)).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out


def counted(documents: DataFrame, text_col: str = "text", topics: Column | None = None) -> DataFrame:
    """documents with topic (by default the rule of TOPICS; any expression will do) and n_tokens."""
    return documents.withColumns({"topic": topic(column(text_col)) if topics is None else topics, "n_tokens": token_count(column(text_col))})


def rates(given: DataFrame, wanted: dict[str, DataFrame | float], budget: float = BUDGET) -> DataFrame:
    """(_source, _lang, _topic, _rate): the probability of the documents of each cell that has tokens."""
    cells = cut(given.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    raked = rake(cells, {m: cut(shares(cells, m, w)) for m, w in wanted.items()}, budget)
    rate = F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(budget) * F.lit(whole) / F.col("tokens")), 9)
    return cut(raked.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], rate.alias("_rate")))


def decided(given: DataFrame, rated: DataFrame, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """given with probability and kept, by the rates of its cells."""
    # documents stay where they are unless cells are very many; then Spark splits the join's large keys
    same = reduce(lambda a, b: a & b, [F.col(f"_{m}").eqNullSafe(F.col(m)) for m in MARGINS])
    out = given.join(broadcast_if_small(rated, BROADCAST_CELLS), same, "left")
    out = out.withColumn("probability", F.when(F.col("n_tokens") > 0, F.coalesce("_rate", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("kept", uniform(column(id_col), seed) < F.col("probability"))
    return out.drop("_rate", *[f"_{m}" for m in MARGINS])


def mix(documents: DataFrame, wanted: dict[str, DataFrame | float], budget: float = BUDGET, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", topics: Column | None = None) -> DataFrame:
    """Every document row with its columns and topic, n_tokens, probability and kept.

    wanted gives each margin a table of target shares or a power (see `shares`).  probability is the wanted tokens of a
    cell (its raked weight times budget times all tokens) over the tokens it has, 1 at most, rounded to nine places;
    kept is decided by a hash of seed and id, alike in every run, and equal ids are decided alike.  A null source or
    language is a value of its own.  A document without tokens has a probability of 0 and isn't kept; a null id hashes as
    an empty one.  Columns of these names are replaced.
    """
    given = counted(documents, text_col, topics)
    return decided(given, rates(given, wanted, budget), seed, id_col)


def sampled(documents: DataFrame, wanted: dict[str, DataFrame | float], budget: float = BUDGET, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The decisions of `mix` without the texts: (id, margins, n_tokens, probability, kept), from one scan of the documents."""
    given = cut(counted(documents, text_col).select(column(id_col), *MARGINS, "n_tokens"))
    return decided(given, rates(given, wanted, budget), seed, id_col)


def uniform(key: Column, seed: str) -> Column:
    """0 to 1 from the first 52 bits of SHA-256 of seed, a colon and the key's text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
