"""Queries over the data folder, each with equivalent DuckDB SQL."""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmask.functions import masking, patterns
from sparkmask.operators import keyset, sweep
from sparkmask.operators.rule_queries import RULE_QUERIES, RULE_SQL
from sparkmask.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: String columns by table, in the order of the tables and their columns.
STRINGS = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


# SQL counterparts of the expressions


def s_scramble(v: str) -> str:
    for pattern, by in masking.CLASSES:
        v = f"regexp_replace({v}, '{pattern}', '{by}', 'g')"
    return v


def s_unique(v: str, key: str) -> str:
    s, tail = s_scramble(v), f"('#' || {key})"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN length({s}) > length({tail}) THEN left({s}, length({s}) - length({tail})) || {tail} ELSE {tail} END"


def s_text(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def s_matches(v: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({v}, '{patterns.PATTERNS[pattern]}'), false)"


def s_prefilter(v: str) -> str:
    return "coalesce(" + " OR ".join(f"regexp_matches({v}, '{p}')" for p in patterns.PREFILTERS.values()) + ", false)"


def s_scrambled(v: str) -> str:
    return rf"coalesce(regexp_matches({v}, '[xX9]') AND NOT regexp_matches(regexp_replace({v}, '[xX9]', '', 'g'), '[\p{{L}}\p{{Nd}}]'), false)"


def s_scrambled_key(v: str) -> str:
    return f"coalesce(regexp_matches({v}, '{patterns.WITH_KEY}') AND {s_scrambled(f"regexp_extract({v}, '{patterns.WITH_KEY}', 1)")}, false)"


def s_email(v: str) -> str:
    return f"coalesce(regexp_matches({v}, '{patterns.GENERATED_EMAIL}'), false)"


def s_masked(v: str, known: tuple[str, ...] = ()) -> str:
    tests = [s_scrambled(v), s_scrambled_key(v), s_email(v)]
    if known:
        tests.append(f"coalesce({v} IN ({', '.join(f"'{k}'" for k in known)}), false)")
    return "(" + " OR ".join(tests) + ")"


# Strategies

query("strategy_null", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_acctbal IS NULL AS was_null FROM customer")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", masking.constant(None, "double").alias("c_acctbal"), F.col("c_acctbal").isNull().alias("was_null"))
)
query("strategy_static", "SELECT c_custkey, 'Dev' AS c_mktsegment, CAST(42 AS SMALLINT) AS c_small, '1970-01-01' AS c_date FROM customer")(
    lambda spark, d: table(spark, d, "customer").select(
        "c_custkey", masking.constant("Dev", "string").alias("c_mktsegment"), masking.constant(42, "smallint").alias("c_small"), masking.constant("1970-01-01", "date").cast("string").alias("c_date")
    )
)


@query(
    "strategy_static_overwrites_null",
    "SELECT event_id, event_id % 7 = 0 AS was_null, '[redacted]' AS event_type FROM events",
)
def strategy_static_overwrites_null(spark, d):
    given = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return given.select("event_id", F.col("event_type").isNull().alias("was_null"), masking.constant("[redacted]", "string").alias("event_type"))


query("strategy_keep", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(lambda spark, d: table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
query("strategy_email", "SELECT c_custkey, 'fakeemail' || CAST(c_custkey AS VARCHAR) || '@notreal.invalid' AS email FROM customer")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", masking.generated_email(masking.discriminator([F.col("c_custkey")])).alias("email"))
)
query(
    "strategy_email_composite",
    "SELECT conv_id, turn, 'fakeemail' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '@notreal.invalid' AS email FROM conversations",
)(lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", masking.generated_email(masking.discriminator([F.col("conv_id"), F.col("turn")])).alias("email")))


def _scrambled(name: str, source: str, key: str, column: str) -> None:
    query(name, f"SELECT {key}, {s_scramble(column)} AS {column} FROM {source}")(lambda spark, d: table(spark, d, source).select(key, masking.scramble(F.col(column)).alias(column)))


_scrambled("scramble_text", "documents", "doc_id", "text")
_scrambled("scramble_html", "pages", "page_id", "html")
_scrambled("scramble_names", "supplier", "s_suppkey", "s_name")

query("scramble_idempotent", f"SELECT doc_id, {s_scramble(s_scramble('text'))} = {s_scramble('text')} AS same FROM documents")(
    lambda spark, d: table(spark, d, "documents").withColumn("once", masking.scramble(F.col("text"))).select("doc_id", (masking.scramble(F.col("once")) == F.col("once")).alias("same"))
)
query(
    "scramble_length_preserved",
    f"SELECT doc_id, CAST(length({s_scramble('text')}) AS BIGINT) AS after, CAST(length(text) AS BIGINT) AS before FROM documents",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", F.length(masking.scramble(F.col("text"))).cast("long").alias("after"), F.length("text").cast("long").alias("before")))
query("scramble_unique_single", f"SELECT c_custkey, {s_unique('c_name', s_text('c_custkey'))} AS c_name FROM customer")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", masking.scramble_unique(F.col("c_name"), masking.discriminator([F.col("c_custkey")])).alias("c_name"))
)
query(
    "scramble_unique_composite",
    f"SELECT conv_id, turn, {s_unique('role', s_text('conv_id') + " || '-' || " + s_text('turn'))} AS role FROM conversations",
)(lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", masking.scramble_unique(F.col("role"), masking.discriminator([F.col("conv_id"), F.col("turn")])).alias("role")))


@query(
    "scramble_unique_short",
    f"SELECT n_nationkey, {s_unique('short', "CAST(n_nationkey * 1000 AS VARCHAR)")} AS short FROM (SELECT *, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE left(n_name, 3) END AS short FROM nation)",
)
def scramble_unique_short(spark, d):
    given = table(spark, d, "nation").withColumn("short", F.when(F.col("n_nationkey") % 7 != 0, F.left("n_name", F.lit(3))))
    return given.select("n_nationkey", masking.scramble_unique(F.col("short"), (F.col("n_nationkey") * 1000).cast("string")).alias("short"))


_CODE = "('acct' || lpad(CAST(c_custkey AS VARCHAR), 5, '0'))"


@query("scramble_unique_distinct", f"SELECT count(*) AS n, count(DISTINCT code) AS n_distinct FROM (SELECT {s_unique(_CODE, s_text('c_custkey'))} AS code FROM customer)")
def scramble_unique_distinct(spark, d):
    code = F.concat(F.lit("acct"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    masked = table(spark, d, "customer").select(masking.scramble_unique(code, F.col("c_custkey").cast("string")).alias("code"))
    return masked.agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_distinct"))


@query(
    "computed_after_mask",
    f"SELECT n_nationkey, {s_scramble('n_name')} AS n_name, 'Dev' AS r_name, {s_scramble('n_name')} || ' ' || 'Dev' AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def computed_after_mask(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    masked = joined.select("n_nationkey", masking.scramble(F.col("n_name")).alias("n_name"), masking.constant("Dev", "string").alias("r_name"))
    return masked.withColumn("full_name", F.concat_ws(" ", "n_name", "r_name"))


@query(
    "mask_customer",
    f"SELECT c_custkey, {s_unique('c_name', s_text('c_custkey'))} AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, 'Dev' AS c_mktsegment FROM customer",
)
def mask_customer(spark, d):
    from sparkmask.operators.mask import masked
    from sparkmask.plans.shortcut import table_plan

    df = table(spark, d, "customer")
    rules = {"c_name": {"strategy": "scramble", "unique": "key"}, "c_mktsegment": {"strategy": "static", "value": "Dev"}, "c_acctbal": {"strategy": "null"}}
    return masked(df, table_plan(df, "main.customer", ["c_custkey"], rules))


@query(
    "mask_all_columns_supplier",
    f"SELECT s_suppkey, 'fakeemail' || CAST(s_suppkey AS VARCHAR) || '@notreal.invalid' AS s_name, CAST(0 AS INTEGER) AS s_nationkey, CAST(12.34 AS DOUBLE) AS s_acctbal FROM supplier",
)
def mask_all_columns_supplier(spark, d):
    from sparkmask.operators.mask import masked
    from sparkmask.plans.shortcut import table_plan

    df = table(spark, d, "supplier")
    rules = {"s_name": {"strategy": "email"}, "s_nationkey": {"strategy": "static", "value": 0}, "s_acctbal": {"strategy": "static", "value": 12.34}}
    return masked(df, table_plan(df, "main.supplier", ["s_suppkey"], rules))


_HISTORY = "SELECT event_id, user_id, event_type, props, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events"


def history(spark, d) -> DataFrame:
    """Versions of each user, as a history table keeps them: an event is valid until the user's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "props", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query(
    "mask_history",
    f"SELECT event_id, user_id, {s_scramble('event_type')} AS event_type, '[redacted]' AS props, valid_from, valid_to FROM ({_HISTORY}) WHERE valid_to IS NOT NULL",
)
def mask_history(spark, d):
    """The history of a versioned table, masked by its parent's rules through the plan."""
    from sparkmask.operators.mask import masked
    from sparkmask.plans import run_plan
    from sparkmask.plans.meta import build_catalog
    from sparkmask.plans.rules import load

    now = history(spark, d)
    facts = {"tables": {"main.state": {"primaryKey": ["event_id"], "history": "main.old"}, "main.old": {"temporal": "history"}}}
    rules = [{"name": "event_type", "strategy": "scramble"}, {"name": "props", "strategy": "static", "value": "[redacted]"}]
    plan = run_plan.build(
        build_catalog("d", {"main.state": now.schema, "main.old": now.schema}, facts), load(json.dumps({"tables": [{"name": "main.state", "history": "mask", "columns": rules}]}))
    )
    mask = next(t for t in plan.mask.tables if t.table.name == "main.old")
    return masked(now.where("valid_to IS NOT NULL"), mask, plan.scrub.catalog.table("main.state"))


@query("truncate_table", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE false")
def truncate_table(spark, d):
    from sparkmask.operators.mask import emptied

    return emptied(table(spark, d, "events"))


# The sweep

_SHAPED = "SELECT 'documents' AS source, doc_id AS id, text AS v FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages"


def shaped(spark, d) -> DataFrame:
    one = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("v"))
    return one.unionByName(table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("v")))


#: Values of every shape made from keys, as the tables hold few of them.
_MADE = """SELECT c_custkey AS id, unnest([
  printf('%03d-%02d-%04d', c_custkey % 1000, c_custkey % 100, c_custkey % 10000), printf('%03d-%03d-%04d', c_custkey % 1000, c_custkey % 999, c_custkey % 10000),
  printf('(%03d)%03d-%04d', c_custkey % 1000, c_custkey % 999, c_custkey % 10000), printf('call %03d.%03d.%04d now', c_custkey % 1000, c_custkey % 999, c_custkey % 10000),
  'a@b' || CAST(c_custkey % 10 AS VARCHAR) || '.co', '999-99-9999', 'Xxxx#' || CAST(c_custkey AS VARCHAR), '#' || printf('%03d-%02d-%04d', c_custkey % 1000, c_custkey % 100, c_custkey % 10000),
  'fakeemail' || CAST(c_custkey AS VARCHAR) || '@notreal.invalid', 'dev@example.invalid', 'see dev@example.invalid', CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END, ''
]) AS v FROM customer"""


def made(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    ssn = F.format_string("%03d-%02d-%04d", k % 1000, k % 100, k % 10000)
    three = (k % 1000, k % 999, k % 10000)
    values = [
        ssn, F.format_string("%03d-%03d-%04d", *three), F.format_string("(%03d)%03d-%04d", *three), F.format_string("call %03d.%03d.%04d now", *three),
        F.concat(F.lit("a@b"), (k % 10).cast("string"), F.lit(".co")), F.lit("999-99-9999"), F.concat(F.lit("Xxxx#"), k.cast("string")), F.concat(F.lit("#"), ssn),
        masking.generated_email(k.cast("string")), F.lit("dev@example.invalid"), F.lit("see dev@example.invalid"), F.when(k % 7 != 0, F.col("c_name")), F.lit(""),
    ]
    return table(spark, d, "customer").select(k.alias("id"), F.explode(F.array(*values)).alias("v"))


for _pattern in patterns.PATTERNS:
    query(
        f"pattern_{_pattern.replace('-', '_')}",
        f"SELECT source, id, v FROM (SELECT source, id, v FROM ({_SHAPED}) UNION ALL SELECT 'made', id, v FROM ({_MADE})) WHERE {s_matches('v', _pattern)}",
    )(
        lambda spark, d, p=_pattern: (
            shaped(spark, d).unionByName(made(spark, d).select(F.lit("made").alias("source"), "id", "v")).where(patterns.matches(F.col("v"), p))
        )
    )

query("prefilter_candidates", f"SELECT id, v FROM ({_MADE}) WHERE {s_prefilter('v')}")(lambda spark, d: made(spark, d).where(patterns.prefilter(F.col("v"))))


def _hits_sql(compatible: bool) -> str:
    before = f"{s_prefilter('v')} AND " if compatible else ""
    known = ("dev@example.invalid",)
    return " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) AS hits FROM ({_MADE}) WHERE {before}{s_matches('v', p)} AND NOT {s_masked('v', known)}" for p in patterns.PATTERNS)


def _hits(spark, d, compatible: bool) -> DataFrame:
    v = F.col("v")
    tests = [F.count_if(patterns.leaks(v, p, ["dev@example.invalid"], compatible)).alias(p) for p in patterns.PATTERNS]
    return made(spark, d).agg(*tests).unpivot([], list(patterns.PATTERNS), "pattern", "hits")


query("effective_hits", _hits_sql(False))(lambda spark, d: _hits(spark, d, False))
query("effective_hits_compat", _hits_sql(True))(lambda spark, d: _hits(spark, d, True))

for _name, _test, _sql in (
    ("placeholder_scrambled", patterns.is_scrambled, s_scrambled),
    ("placeholder_scrambled_key", patterns.is_scrambled_with_key, s_scrambled_key),
    ("placeholder_email", patterns.is_generated_email, s_email),
    ("placeholder_known", lambda v: patterns.is_known(v, ["dev@example.invalid", "[redacted]"]), lambda v: f"coalesce({v} IN ('dev@example.invalid', '[redacted]'), false)"),
    ("placeholder_any", lambda v: patterns.is_masked(v, ["dev@example.invalid"]), lambda v: s_masked(v, ("dev@example.invalid",))),
):
    query(_name, f"SELECT id, v, {_sql('v')} AS masked FROM ({_MADE})")(lambda spark, d, t=_test: made(spark, d).select("id", "v", t(F.col("v")).alias("masked")))


def _swept_sql(wrap: Callable[[str], str] = lambda v: v) -> str:
    parts = []
    for t, columns in STRINGS.items():
        for c in columns:
            for p in patterns.PATTERNS:
                v = wrap(c)
                parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{p}' AS pattern, count_if({s_matches(v, p)} AND NOT {s_masked(v)})::BIGINT AS hits FROM {t}")
    return " UNION ALL ".join(parts)


def swept(spark, d, masked: bool = False) -> DataFrame:
    tables = {}
    for t in TABLES:
        df = table(spark, d, t)
        tables[t] = df.withColumns({c: masking.scramble(F.col(c)) for c in STRINGS.get(t, [])}) if masked else df
    return sweep.sweep(tables)


_INSPECTED = " UNION ALL ".join(
    f"SELECT count_if({' OR '.join(s_matches(c, p) for p in patterns.PATTERNS)})::BIGINT AS inspected, count_if(NOT {s_masked(c)} AND {s_matches(c, 'email')})::BIGINT AS first FROM {t}"
    for t, columns in STRINGS.items()
    for c in columns
)

query("verify_hits", f"SELECT * FROM ({_swept_sql()}) WHERE hits > 0")(lambda spark, d: swept(spark, d).where("hits > 0").drop("inspected"))
query("verify_hits_after_mask", f"SELECT CAST(sum(hits) AS BIGINT) AS hits, count(*) AS tests, sum(hits) = 0 AS passed FROM ({_swept_sql(s_scramble)})")(
    lambda spark, d: swept(spark, d, masked=True).agg(F.sum("hits").alias("hits"), F.count("*").alias("tests"), (F.sum("hits") == 0).alias("passed"))
)
query(
    "verify_totals",
    f"SELECT (SELECT count(*) FROM ({_INSPECTED})) AS columns_scanned, (SELECT CAST(sum(inspected) AS BIGINT) FROM ({_INSPECTED})) AS rows_inspected, (SELECT CAST(sum(hits) AS BIGINT) FROM ({_swept_sql()})) AS total_hits",
)(lambda spark, d: sweep.totals(swept(spark, d)).drop("passed"))
query("verify_pass", f"SELECT max(hits) = 0 AS passed FROM ({_swept_sql()})")(lambda spark, d: sweep.totals(swept(spark, d)).select("passed"))
query(
    "verify_rollup",
    f'SELECT "table", "column", pattern, CAST(sum(hits) AS BIGINT) AS hits FROM ({_swept_sql()}) GROUP BY ROLLUP ("table", "column", pattern)',
)(lambda spark, d: swept(spark, d).rollup("table", "column", "pattern").agg(F.sum("hits").alias("hits")))
query("verify_worst_columns", f'SELECT "table", "column", CAST(sum(hits) AS BIGINT) AS hits FROM ({_swept_sql()}) GROUP BY ALL ORDER BY hits DESC, "table", "column" LIMIT 12')(
    lambda spark, d: swept(spark, d).groupBy("table", "column").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "table", "column").limit(12)
)

# The same over streams

_MAILS = "SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(user_id AS VARCHAR) || '@example.invalid' ELSE event_type END AS v FROM events"


def mails(events: DataFrame) -> DataFrame:
    """Events with an address in every third row."""
    address = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.invalid"))
    return events.select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, address).otherwise(F.col("event_type")).alias("v"))


def _streamed(spark, d, change: Callable[[DataFrame], DataFrame], mode: str, check: bool = False) -> DataFrame:
    """What a stream over the events writes, all micro-batches together; with `check` each passes the gate first."""
    from sparkmask.streaming import stream

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    given = stream.read_folder(spark, d, table(spark, d, "events").schema, "events.parquet")
    write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
    out = change(given)
    sink = out.writeStream.outputMode(mode).foreachBatch(stream.gate(write) if check else write)
    sink.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out/epoch=*")


@query("stream_mask", f"SELECT event_id, ts, {s_scramble('v')} AS v FROM ({_MAILS})")
def stream_mask(spark, d):
    """A mask over a stream, each micro-batch swept before it is written."""
    from sparkmask.plans.shortcut import table_plan
    from sparkmask.streaming import stream

    plan = table_plan(mails(table(spark, d, "events")), "main.mails", ["event_id"], {"v": {"strategy": "scramble"}})
    return _streamed(spark, d, lambda given: stream.mask_stream(mails(given), plan), "append", check=True)


@query(
    "stream_hits_by_window",
    f"""SELECT date_trunc('day', ts) AS day, pattern, CAST(sum(CASE WHEN pattern = 'email' AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS rows
FROM ({_MAILS}), (VALUES {', '.join(f"('{p}')" for p in patterns.PATTERNS)}) AS p(pattern) GROUP BY ALL""",
)
def stream_hits_by_window(spark, d):
    """Hits by day over a stream with a watermark; complete windows, as the source ends."""
    from sparkmask.streaming import stream

    out = _streamed(spark, d, lambda given: stream.hit_rate(mails(given), "ts", "v", "1 day", "400 days"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "pattern", "hits", "rows")


@query("lateral_hits", f"SELECT id, pattern FROM ({_MADE}), (VALUES {', '.join(f"('{p}')" for p in patterns.PATTERNS)}) AS p(pattern) WHERE CASE pattern {' '.join(f"WHEN '{p}' THEN {s_matches('v', p)}" for p in patterns.PATTERNS)} END")
def lateral_hits(spark, d):
    """A row for each value and shape that it holds, by a lateral generator over the shapes."""
    found = F.filter(F.array(*[F.when(patterns.matches(F.col("v"), p), p) for p in patterns.PATTERNS]), lambda p: p.isNotNull())
    return made(spark, d).withColumn("found", found).select("id", F.explode("found").alias("pattern"))


# Keys, pages, reconciliation

_KEYS = {"customer": ["c_custkey"], "conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"]}


def key_candidates(spark, d):
    out = None
    for t, keys in _KEYS.items():
        one = keyset.key_quality(table(spark, d, t), keys).select(F.lit(t).alias("table"), F.lit(",".join(keys)).alias("columns"), "*")
        out = one if out is None else out.unionByName(one)
    return out


query(
    "key_candidates",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{','.join(k)}' AS \"columns\", count(*) AS rows, count(DISTINCT ({', '.join(k)}, 1)) AS distinct_keys, "
        f"count_if({' OR '.join(f'{c} IS NULL' for c in k)})::BIGINT AS null_keys, count(*) = count(DISTINCT ({', '.join(k)}, 1)) AND count_if({' OR '.join(f'{c} IS NULL' for c in k)}) = 0 AS is_key FROM {t}"
        for t, k in _KEYS.items()
    ),
)(key_candidates)


@query("unique_rule_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_rule_check(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


query("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25")(lambda spark, d: keyset.page(table(spark, d, "customer"), ["c_custkey"], 25, [40]).select("c_custkey", "c_name"))
query("keyset_page_first", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")(lambda spark, d: keyset.page(table(spark, d, "customer"), ["c_custkey"], 25).select("c_custkey"))
query(
    "keyset_page_composite",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 1) ORDER BY conv_id, turn LIMIT 20",
)(lambda spark, d: keyset.page(table(spark, d, "conversations"), ["conv_id", "turn"], 20, [3, 1]).select("conv_id", "turn", "role"))


@query(
    "range_update_rows",
    "SELECT conv_id, turn, CASE WHEN (conv_id > 3 OR (conv_id = 3 AND turn > 1)) AND NOT (conv_id > 9 OR (conv_id = 9 AND turn > 2)) THEN '[redacted]' ELSE role END AS role FROM conversations",
)
def range_update_rows(spark, d):
    inside = keyset.between(["conv_id", "turn"], [3, 1], [9, 2])
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(inside, "[redacted]").otherwise(F.col("role")).alias("role"))


@query(
    "keyed_update",
    f"SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name FROM customer c LEFT JOIN (SELECT c_custkey, {s_scramble('c_name')} AS c_name FROM customer WHERE c_custkey % 3 = 0) n USING (c_custkey)",
)
def keyed_update(spark, d):
    from sparkmask.operators.mask import keyed_update as update

    df = table(spark, d, "customer").select("c_custkey", "c_name")
    new = df.where("c_custkey % 3 = 0").select("c_custkey", masking.scramble(F.col("c_name")).alias("c_name"))
    return update(df, new, ["c_custkey"])


query("row_count", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES))(
    lambda spark, d: __import__("functools").reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in TABLES])
)


@query(
    "reconcile_rows",
    "SELECT (SELECT count(*) FROM customer) AS rows_before, (SELECT count(*) FROM customer WHERE c_custkey % 50 <> 0) + 1 AS rows_after, "
    "(SELECT count(*) FROM customer WHERE c_custkey % 50 = 0) AS missing, CAST(1 AS BIGINT) AS added, false AS complete",
)
def reconcile_rows(spark, d):
    df = table(spark, d, "customer").select("c_custkey")
    now = df.where("c_custkey % 50 <> 0").unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS c_custkey"))
    return keyset.reconcile(df, now, ["c_custkey"])


@query("key_width_check", "SELECT CAST(max(length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS widest, CAST(20 AS BIGINT) AS planned, max(length(CAST(c_custkey AS VARCHAR))) <= 20 AS fits FROM customer")
def key_width_check(spark, d):
    from sparkmask.plans.keys import max_width

    df = table(spark, d, "customer")
    planned = max_width([df.schema["c_custkey"].dataType])
    widest = F.max(F.length(F.col("c_custkey").cast("string"))).cast("long")
    return df.agg(widest.alias("widest"), F.lit(planned).cast("long").alias("planned"), (widest <= planned).alias("fits"))


def masked_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pattern, before, after): hits in documents.text as it is and scrambled."""
    text = F.col("text")
    both = sweep.counts(table(spark, sf_dir, "documents").select(text.alias("before"), masking.scramble(text).alias("after")))
    hits = lambda c: F.sum(F.when(F.col("column") == c, F.col("hits"))).alias(c)
    return both.groupBy("pattern").agg(hits("before"), hits("after")).orderBy("pattern")


query(
    "masked_before_after",
    " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, count_if({s_matches('text', p)} AND NOT {s_masked('text')})::BIGINT AS before, count_if({s_matches('s', p)} AND NOT {s_masked('s')})::BIGINT AS after "
        f"FROM (SELECT text, {s_scramble('text')} AS s FROM documents)"
        for p in patterns.PATTERNS
    ),
)(masked_before_after)

QUERIES |= RULE_QUERIES
ORACLE_SQL |= RULE_SQL

