"""The queries opN_<name> over the tables of a data folder, with production parameters, and their SQL where there is one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, licenses, mixing, neardup, pii, quality, secrets, toxicity, vectors
from .common import cut, stable_bucket, table

TOXIC_CUT, QUALITY_CUT = 0.5, 0.7


def _held_out(folds: int, fold: int):
    """Whether a doc_id falls in the fold that no label is learned from; a null id doesn't."""
    return F.coalesce(stable_bucket(F.col("doc_id"), folds) == fold, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: (doc_id, held_out, score, predicted)."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~_held_out(5, 0)))
    return toxicity.apply(documents, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: (doc_id, held_out, score, predicted)."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels.where(~_held_out(4, 2)), QUALITY_CUT)
    return quality.apply(documents, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != pii.KIND)
    return found.select("doc_id", *map(count, pii.PATTERNS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: (doc_id, n_shingles, component_id, kept)."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors: (vec_id, n_links, component_id, kept)."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents: (doc_id, start, end, license, reduction, n_words, n_different, exact)."""
    return licenses.license_blocks(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Target shares of tokens by language and topic, and 0 to even out sources.
MIX_TARGETS = {
    "source": 0.0,
    "lang": {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13},
    "topic": {"license": 0.03, "contact": 0.04, "code": 0.10, "prose": 0.83},
}


def mix_targets(spark: SparkSession) -> dict:
    """MIX_TARGETS as tables (key, target) and powers."""
    return {m: spark.createDataFrame(list(t.items()), "key string, target double") if isinstance(t, dict) else t for m, t in MIX_TARGETS.items()}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling decision for every document: (doc_id, source, lang, topic, n_tokens, probability, kept)."""
    return mixing.sampled(table(spark, sf_dir, "documents"), mix_targets(spark))


def mixing_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the raked weights of op8_mixing come to their targets: (margin, key, target, reached)."""
    given = mixing.counted(table(spark, sf_dir, "documents"))
    cells = cut(given.groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    targets = {m: cut(mixing.shares(cells, m, w)) for m, w in mix_targets(spark).items()}
    found = mixing.gaps(mixing.rake(cells, targets, mixing.BUDGET), targets)
    return found.select("margin", "key", F.round("target", 7).alias("target"), F.round("reached", 7).alias("reached"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's text of every page: (page_id, url, text, n_chars)."""
    return html.article_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_pii finds of the base kinds, which SQL can express: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256)."""
    return op3_pii(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_secrets finds of the base kinds, which SQL can express: (doc_id, n_assign, n_access, n_hex, base_sha256)."""
    return op10_secrets(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_minhash": op4_minhash,
    "op5_embeddings": op5_embeddings,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "mixing_margins": mixing_margins,
    "op9_html": op9_html,
    "op10_secrets": op10_secrets,
    "pii_base": pii_base,
    "secrets_base": secrets_base,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id that links reach, by repeated steps along links.
_REACHED = """
reached(id, component) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT links.b, reached.component FROM reached JOIN links ON links.a = reached.id WHERE reached.component < links.b
)"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _raking_sql(documents: str) -> str:
    """The cells, targets and raked weights of op8, round by round."""
    tests = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in mixing.TOPICS.items() if p)
    parts = [
        f"given AS (SELECT doc_id, source, lang, CASE {tests} ELSE '{list(mixing.TOPICS)[-1]}' END AS topic, "
        rf"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM {documents})",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM given GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m, wanted in MIX_TARGETS.items():
        sums = f"(SELECT {m} AS key, sum(tokens) AS t FROM cells GROUP BY ALL)"
        share = f"pow(t, {wanted})"
        if isinstance(wanted, dict):
            named = ", ".join(f"('{k}', {v})" for k, v in wanted.items())
            sums = f"(SELECT s.*, n.target AS named FROM {sums} s LEFT JOIN (VALUES {named}) AS n(key, target) ON n.key IS NOT DISTINCT FROM s.key)"
            share = f"coalesce(named, {max(0.0, 1 - sum(wanted.values()))} * t / (sum(t) FILTER (named IS NULL) OVER ()))"
        parts.append(f"target_{m} AS MATERIALIZED (SELECT key, share / sum(share) OVER () AS target FROM (SELECT key, {share} AS share FROM {sums}))")
    joins = " ".join(f"LEFT JOIN target_{m} ON target_{m}.key IS NOT DISTINCT FROM c.{m}" for m in MIX_TARGETS)
    wants = ", ".join(f"target_{m}.target AS want_{m}" for m in MIX_TARGETS)
    start = f"SELECT 0 AS round, c.*, tokens / ({mixing.BUDGET} * sum(tokens) OVER ()) AS cap, {wants}, CAST(tokens AS DOUBLE) AS weight FROM cells c {joins}"
    step = "(SELECT * FROM raked)"
    for m in MIX_TARGETS:
        step = f"(SELECT * REPLACE (least(cap, weight * (want_{m} / sum(weight) OVER (PARTITION BY {m}))) AS weight) FROM {step})"
    gap = "greatest(" + ", ".join(f"abs(sum(weight) OVER (PARTITION BY {m}) - want_{m})" for m in MIX_TARGETS) + ")"
    rows = "round, source, lang, topic, tokens, cap, " + ", ".join(f"want_{m}" for m in MIX_TARGETS) + ", weight"
    going = f"round < {mixing.ROUNDS} AND (round % {mixing.CHECKED} <> 0 OR far > {mixing.TOLERANCE})"
    parts.append(
        f"raked AS (SELECT *, 1.0::DOUBLE AS far FROM ({start}) UNION ALL "
        f"SELECT {rows}, max(gap) OVER () AS far FROM (SELECT * REPLACE (round + 1 AS round), {gap} AS gap FROM {step} WHERE {going}))"
    )
    parts.append("final AS MATERIALIZED (SELECT * FROM raked WHERE round = (SELECT max(round) FROM raked))")
    return f"WITH RECURSIVE {', '.join(parts)}"


def _mixing_sql(documents: str) -> str:
    """The decisions of op8."""
    same = " AND ".join(f"r.{m} IS NOT DISTINCT FROM g.{m}" for m in mixing.MARGINS)
    rate = f"SELECT *, round(least(1.0, weight * {mixing.BUDGET} * sum(tokens) OVER () / tokens), 9) AS rate FROM final"
    return (
        f"{_raking_sql(documents)} SELECT doc_id, g.source, g.lang, g.topic, n_tokens, probability, "
        "CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept "
        "FROM (SELECT g.*, CASE WHEN n_tokens > 0 THEN coalesce(rate, 0.0) ELSE 0.0 END AS probability "
        f"FROM given g LEFT JOIN ({rate}) r ON {same}) g"
    )


def _margins_sql(documents: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS margin, key, round(target, 7) AS target, round(coalesce(sum(weight), 0.0), 7) AS reached FROM target_{m} LEFT JOIN final ON {m} IS NOT DISTINCT FROM key GROUP BY key, target" for m in MIX_TARGETS)
    return f"{_raking_sql(documents)} {each}"


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CAST({_DIGITS}[i] AS INT) * 2
  - CASE WHEN (len({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"""
_KEYWORD = "|".join("_?".join("".join(f"[{c}{c.upper()}]" for c in part) for part in word) for word in (("password",), ("passwd",), ("secret",), ("token",), ("api", "key")))
_ASSIGN = rf"""({_KEYWORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: Pattern of each base kind and what its matches must be.
_PII_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15"),
}
_SECRET_KINDS = {
    "assign": (_ASSIGN, f"len(regexp_extract(v, '{_ASSIGN}', 2)) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "len(v) >= 20"),
    "hex": ("[0-9a-f]+", "len(v) >= 24"),
}


def _base_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """Counts and digest of base spans; a match begins where the parts before it and the matches before it end."""
    each = " UNION ALL ".join(
        f"""SELECT r, {rank} AS rank, '{kind}' AS kind, v, stop FROM (
  SELECT r, v, sum(len(gap) + len(v)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
    SELECT r, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM texts)))
  WHERE {valid}"""
        for rank, (kind, (pattern, valid)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({each})
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg(kind || ':' || CAST(stop - len(v) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - len(v), rank), '')) AS base_sha256
FROM texts LEFT JOIN found USING (r) GROUP BY r
"""


ORACLE_SQL: dict[str, str] = {
    "op4_minhash": rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT id, len(w) AS k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts
), runs AS (
  SELECT id, k, word || coalesce(' ' || lead(word) OVER o, '') || coalesce(' ' || lead(word, 2) OVER o, '') AS shingle, p
  FROM words WINDOW o AS (PARTITION BY id ORDER BY p)
), shingles AS MATERIALIZED (
  SELECT id, shingle, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, shingle FROM runs WHERE p <= greatest(k - 2, 1))
), nodes AS MATERIALIZED (
  SELECT doc_id AS id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT id, any_value(n) AS n FROM shingles GROUP BY id) ON id = doc_id
), links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM shingles x JOIN shingles y USING (shingle)
  WHERE x.id <> y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), {_REACHED}
SELECT id AS doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(component AS BIGINT) AS component_id, id = component AS kept
FROM nodes JOIN (SELECT id, min(component) AS component FROM reached GROUP BY id) USING (id)
""",
    "op5_embeddings": f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS MATERIALIZED (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.98
), nodes AS (SELECT id FROM vectors
), {_REACHED}
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component AS BIGINT) AS component_id, id = component AS kept
FROM (SELECT id, min(component) AS component FROM reached GROUP BY id)
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = id
""",
    "op7_decontamination": rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts
), ahead AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM words
), places AS (
  SELECT doc_id, n, i, array_to_string(w[1:n], ' ') AS t FROM ahead, sizes WHERE len(w) >= n
), hits AS (SELECT doc_id, item, n, i FROM places JOIN windows USING (n, t)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
    "op8_mixing": _mixing_sql("documents"),
    "mixing_margins": _margins_sql("documents"),
    "pii_base": _base_sql(_PII_KINDS),
    "secrets_base": _base_sql(_SECRET_KINDS),
}
