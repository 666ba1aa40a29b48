"""PII by bootstrapped contextual extraction, with DataFrame functions alone.

Shapes that are certain (email, ip, card, phone) are the seeds.  The words around them become lexical patterns.  Other
tokens that look like identifiers are candidates; a graph joins patterns with the instances they surround.  In each
round a pattern's confidence is the share of its instances that are believed, and a candidate is believed as far as its
patterns are.  Candidates next to a confident pattern become spans of the kind `ident`.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column

from .common import cut, dealt_anew

#: Base kinds in the order that breaks ties.  Possessive forms and the test for the beginning of a run leave the matches
#: of the plain patterns as they are, but keep the search linear on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What must occur in a text for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A candidate: a token of five characters and more, or several joined by spaces, that holds CANDIDATE_DIGITS digits; up
#: to five letters may lead it.  It has no upper length, and whether it is an identifier is for its patterns to say.
CANDIDATE = r"(?<![A-Za-z0-9._%+@/-])(?:[A-Za-z]{1,5}[-#]?)?[0-9](?:[-./]?[0-9A-Za-z]| [0-9]){4,}+(?![A-Za-z0-9@])"
CANDIDATE_DIGITS = 5
KIND = "ident"
#: Rounds over the graph; least confidence of a pattern; least number of distinct believed instances behind it.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 5
#: Characters of context on either side that words are taken from.
CONTEXT = 48
#: Matches that are numbered together; arrays of results are copied at each step, so long texts take them in blocks.
BLOCK = 256

_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
_CHECKED = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by 10."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == KIND:
        return n >= CANDIDATE_DIGITS
    return F.lit(True)


def _located(df: DataFrame, name: str, pattern: str, needed: str) -> DataFrame:
    """Adds column `name`: all matches with code point bounds and the text on either side of each."""
    empty = F.array().cast("array<string>")
    may = F.contains("text", F.lit(needed)) if needed else F.lit(True)
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(empty))

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        before, value = F.element_at("_s", i), F.element_at("_m", i)
        start = at + F.length(before)
        end = start + F.length(value)
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            value.alias("value"),
            F.right(before, F.lit(CONTEXT)).alias("left"),
            F.left(F.element_at("_s", i + 1), F.lit(CONTEXT)).alias("right"),
        )
        return end, F.array(span)

    return df.withColumn(name, _scanned(F.size("_m"), _SPAN, step)).drop("_m", "_s")


def _scanned(n: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The items of step(carry, i) for i from 1 to n; it gives the next carry, which is 0 at first, and an array of items."""

    def one(state: Column, i: Column) -> Column:
        carry, items = step(state["carry"], i)
        return F.struct(carry.alias("carry"), F.concat(state["out"], items).alias("out"))

    def block(state: Column, first: Column) -> Column:
        begin = F.struct(state["carry"].alias("carry"), F.array().cast(kind).alias("out"))
        done = F.aggregate(F.sequence(first, F.least(first + (BLOCK - 1), n)), begin, one)
        # through an array, as the block would be made once for each field otherwise
        return F.transform(F.array(done), lambda s: F.struct(s["carry"].alias("carry"), F.concat(state["out"], F.array(s["out"])).alias("out")))[0]

    begin = F.struct(F.lit(0).alias("carry"), F.array().cast(f"array<{kind}>").alias("out"))
    items = F.aggregate(F.sequence(F.lit(1), n, F.lit(BLOCK)), begin, block, lambda s: F.flatten(s["out"]))
    return F.coalesce(F.when(n > 0, items), F.array().cast(kind))


def located(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, candidates) of every row: arrays of (kind, start, end, value, left, right)."""
    df = documents.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        df = _located(df, kind, pattern, NEEDED[kind])
    df = _located(df, KIND, CANDIDATE, "")
    kinds = {k: _checked(k) for k in (*PATTERNS, KIND)}
    df = df.select("id", F.concat(*[kinds[k] for k in PATTERNS]).alias("base"), kinds[KIND].alias("found"))

    # by start, base spans first where starts are equal: a candidate overlaps one that reaches beyond its start or the next
    def marked(spans: str, new: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s["end"].alias("end"), s.alias("span")))

    df = df.select("id", "base", F.when(F.size("found") > 0, F.array_sort(F.concat(marked("base", 0), marked("found", 1)))).alias("all"))

    def step(reach: Column, i: Column) -> tuple[Column, Column]:
        own, after = F.element_at("all", i), F.get("all", i)
        base = own["new"] == 0
        taken = base | (reach > own["start"]) | F.coalesce((after["new"] == 0) & (after["start"] < own["end"]), F.lit(False))
        return F.when(base, F.greatest(reach, own["end"])).otherwise(reach), F.when(taken, F.array().cast(_CHECKED)).otherwise(F.array(own["span"]))

    return df.select("id", "base", _scanned(F.coalesce(F.size("all"), F.lit(0)), _CHECKED, step).alias("candidates"))


def _checked(kind: str) -> Column:
    """The column of matches of a kind without those that fail its test, with the kind in each."""
    names = ("start", "end", "value", "left", "right")
    good = F.filter(kind, lambda s: _valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[n].alias(n) for n in names]))


def lexical(left: Column, right: Column) -> Column:
    """Patterns of a span: the word before it, the two words before it, and the word after it, letters alone."""
    before = F.regexp_extract_all(F.lower(left), F.lit(r"\p{L}++|[:=#]"), F.lit(0))
    after = F.regexp_extract_all(F.lower(right), F.lit(r"\p{L}++|[:=#]"), F.lit(0))
    n = F.size(before)
    both = F.array(
        F.when(n >= 1, F.concat(F.lit("< "), F.element_at(before, -1))),
        F.when(n >= 2, F.concat(F.lit("<< "), F.array_join(F.slice(before, F.greatest(n - 1, F.lit(1)), 2), " "))),
        F.when(F.size(after) >= 1, F.concat(F.lit("> "), F.element_at(after, 1))),
    )
    return F.filter(both, lambda p: p.isNotNull())


def confident_patterns(spans: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, confidence) of the patterns that the graph supports.

    spans: (value, seed, patterns).  An instance is a value; a seed is believed fully and stays so.
    """
    edges = spans.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges = cut(edges.withColumn("belief", F.col("seed").cast("double")))
    scored = None
    for k in range(rounds):
        scored = edges.groupBy("pattern").agg(F.sum("belief").alias("believed"), F.count("*").alias("n"), F.count_if(F.col("belief") >= confident).alias("behind"))
        scored = scored.select("pattern", (F.col("believed") / (F.col("n") + 1)).alias("confidence"), "behind")
        if k + 1 < rounds:
            trusted = F.when(F.col("behind") >= support, F.col("confidence")).otherwise(0.0)
            rated = edges.join(dealt_anew(scored.select("pattern", trusted.alias("confidence"))), "pattern")
            beliefs = rated.groupBy("value").agg(F.max("confidence").alias("best"))
            edges = edges.drop("belief").join(beliefs, "value")
            edges = cut(edges.select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("belief")))
    return scored.where((F.col("behind") >= support) & (F.col("confidence") >= confident)).select("pattern", "confidence")


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: arrays of (kind, start, end) by start and kind, in code points, end exclusive.

    Null and empty texts have no spans.  Base kinds are what PATTERNS and their tests give; spans of the kind `ident`
    come from patterns and never overlap a base span.  Rows have a number of their own inside, so each keeps the spans of
    its own text, whether its id is null, repeated or not; other columns, whatever they are called, take no part.
    """
    found = cut(located(documents, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode(F.concat(F.transform("base", lambda s: _instance(s, True)), F.transform("candidates", lambda s: _instance(s, False)))).alias("s"))
    each = cut(each.select("row", "s.*").withColumn("patterns", lexical(F.col("left"), F.col("right"))).drop("left", "right"))
    patterns = confident_patterns(each.select("value", "seed", "patterns"))
    new = each.where("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = new.join(dealt_anew(patterns), "pattern").groupBy("row", "start", "end").agg(F.max("confidence").alias("confidence"))
    new = new.groupBy("row").agg(F.collect_list(F.struct(F.lit(KIND).alias("kind"), "start", "end")).alias("new"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate((*PATTERNS, KIND)) for x in (k, i)])
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.concat(base, F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = found.select("row", "id", "base").join(new, "row", "left")
    return out.select(F.col("id").alias(id_col), F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _instance(s: Column, seed: bool) -> Column:
    return F.struct(F.lit(seed).alias("seed"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), s["left"].alias("left"), s["right"].alias("right"))
