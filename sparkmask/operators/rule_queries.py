"""Queries over rules and schema facts.  Small inline facts go through the planner here and through plain SQL there."""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmask.functions import names
from sparkmask.operators import stamp
from sparkmask.plans import keys, meta, report, run_plan, safety
from sparkmask.plans.meta import TOOL_TABLE, Catalog, ColumnMeta, TableMeta, build_catalog
from sparkmask.plans.rules import ALLOWED_SERVERS, InvalidRules, StaticSpec, load, nearest
from sparkmask.plans.static_value import Refused, convert
from sparkmask.plans.verdicts import Action, Kind

RULE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RULE_SQL: dict[str, str] = {}

#: Schema facts of a small database: table, ordinal, column, type, nullable, computed, identity, in key, history of, generated.
FACTS = [
    ("dbo.Person", 1, "PersonId", "int", False, False, True, True, None, False),
    ("dbo.Person", 2, "FirstName", "varchar(100)", True, False, False, False, None, False),
    ("dbo.Person", 3, "LastName", "varchar(100)", True, False, False, False, None, False),
    ("dbo.Person", 4, "Email", "varchar(256)", False, False, False, False, None, False),
    ("dbo.Person", 5, "Ssn", "char(11)", True, False, False, False, None, False),
    ("dbo.Person", 6, "Phone", "varchar(20)", True, False, False, False, None, False),
    ("dbo.Person", 7, "Notes", "string", True, False, False, False, None, False),
    ("dbo.Person", 8, "FullName", "string", True, True, False, False, None, False),
    ("dbo.Person", 9, "CreatedUtc", "timestamp_ntz", False, False, False, False, None, False),
    ("dbo.Person", 10, "ValidFrom", "timestamp_ntz", False, False, False, False, None, True),
    ("dbo.Person", 11, "ValidTo", "timestamp_ntz", False, False, False, False, None, True),
    ("dbo.PersonHistory", 1, "PersonId", "int", False, False, False, False, "dbo.Person", False),
    ("dbo.PersonHistory", 2, "LastName", "varchar(100)", True, False, False, False, "dbo.Person", False),
    ("app.Enrollment", 1, "EnrollmentId", "int", False, False, True, True, None, False),
    ("app.Enrollment", 2, "PersonId", "int", False, False, False, False, None, False),
    ("app.Enrollment", 3, "Notes", "varchar(1000)", True, False, False, False, None, False),
    ("app.Membership", 1, "OrganizationId", "int", False, False, False, True, None, False),
    ("app.Membership", 2, "MemberNumber", "int", False, False, False, True, None, False),
    ("app.Membership", 3, "Username", "varchar(100)", False, False, False, False, None, False),
    ("app.Membership", 4, "Email", "varchar(256)", False, False, False, False, None, False),
    ("app.Membership", 5, "Nickname", "varchar(50)", True, False, False, False, None, False),
    ("dbo.LoginAudit", 1, "Id", "bigint", False, False, True, True, None, False),
    ("dbo.LoginAudit", 2, "UserName", "varchar(256)", True, False, False, False, None, False),
    ("dbo.ContactImport", 1, "SourceFile", "varchar(260)", True, False, False, False, None, False),
    ("dbo.ContactImport", 2, "Email", "varchar(256)", True, False, False, False, None, False),
    ("dbo.ContactImport", 3, "MailingZip", "varchar(10)", True, False, False, False, None, False),
]
FACT_NAMES = ["tbl", "ord", "col", "kind", "nullable", "computed", "identity", "in_key", "history_of", "generated"]
#: Tables beside them that are the system's or the tool's.
SYSTEM = ["sys.tables", "CDC.change_tables", "INFORMATION_SCHEMA.COLUMNS", "dbo.__SanitizationLog"]
#: Rules: table, column (null for a rule of the whole table), strategy, position.
RULES = [
    ("dbo.Person", "PersonId", "keep", 1),
    ("DBO.person", "firstname", "static", 2),
    ("dbo.Person", "LastName", "scramble-unique", 3),
    ("dbo.Person", "Email", "email", 4),
    ("dbo.Person", "Ssn", "scramble", 5),
    ("dbo.Person", "Fax", "null", 6),
    ("dbo.Person", "ssn", "scramble", 7),
    ("app.Membership", "OrganizationId", "keep", 8),
    ("app.Membership", "Username", "scramble-unique", 9),
    ("app.Membership", "Nickname", "static", 10),
    ("dbo.LoginAudit", None, "truncate", 11),
    ("dbo.Gone", "Name", "scramble", 12),
    ("dbo.ContactImport", "Email", "static", 13),
    ("dbo.ContactImport", "SourceFile", "keep", 14),
]
RULE_NAMES = ["tbl", "col", "strategy", "pos"]
INDEXES = [
    ("app.Membership", "UQ_Username", 1, "Username"), ("app.Membership", "IX_Email", 2, "Email"), ("app.Membership", "IX_Email", 1, "OrganizationId"), ("dbo.Person", "UQ_Ssn", 1, "Ssn"),
]
COLUMN_NAMES = (
    "SSN SSNLastFour DOB DateOfBirth PlaceOfBirth Email LoweredEmail HomePhone RegistrarFax MailingAddress MailingZip Password FirstName OtherLastNameUsed "
    "ContactMiddleName LastName LicenseNumber Name DisciplineNotes KnownCapacity ShouldReceiveDisciplineNotificationEmails SendScoreTransferByFax SendCEDataByEmail "
    "UsePodEmailForLVNotifications AttachPhysicalFilesToCEEmail EmailType EmailTypeDescription EmailsId EmailSentLogId EmailSentDate AddressID AddressTypeID "
    "PasswordFormat LicenseStatusID LicenseType VeterinarianId CreatedUtc SortOrder ZipCode Address2 MailingCity mailing_city PhoneNumber Emails"
).split()
TYPOS = ["stragety", "colums", "nmae", "valu", "reson", "strategy", "tables", "xyzzyplugh"]
KNOWN = ["tables", "name", "strategy", "columns", "value", "reason", "unique", "history", "defaults"]
STAMPS = ["true", "True", "TRUE", "1", "  true ", "false", "0", "", "yes", "tru", "maybe", None]


def _literal(v) -> str:
    return "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: list[str], alias: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS {alias}({', '.join(columns)})"


_FACTS, _RULES = _values(FACTS, FACT_NAMES, "f"), _values(RULES, RULE_NAMES, "r")


def _relation(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql}")


_KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "timestamp_ntz": T.TimestampNTZType()}


def catalog(indexes: bool = False) -> Catalog:
    """The facts as the engine's catalog; system tables are among the schemas it is built from."""
    schemas = {n: T.StructType([T.StructField("x", T.IntegerType())]) for n in SYSTEM}
    facts: dict[str, dict] = {}
    for tbl, _, col, kind, nullable, computed, identity, in_key, history_of, generated in FACTS:
        declared = {"__CHAR_VARCHAR_TYPE_STRING": kind} if "char" in kind else {}
        schemas.setdefault(tbl, T.StructType()).add(col, _KINDS.get(kind, T.StringType()), nullable, declared)
        own = facts.setdefault(tbl, {"primaryKey": [], "columns": {}, "unique": {}})
        own["primaryKey"] += [col] * in_key
        own["columns"][col] = {"identity": identity, "generated": generated} | ({"computed": "''"} if computed else {})
        if history_of:
            facts[history_of]["history"], own["temporal"] = tbl, "history"
    for tbl, name, _, col in sorted(INDEXES) if indexes else ():
        facts[tbl]["unique"].setdefault(name, []).append(col)
    return build_catalog("db", schemas, json.dumps({"tables": facts}))


def rule_file(repeated: bool = False) -> str:
    """RULES as a rule file; a column's repeated rules are left out unless wanted."""
    tables: dict[str, dict] = {}
    for tbl, col, strategy, _ in RULES:
        entry = tables.setdefault(tbl.lower(), {"name": tbl})
        if col is None:
            entry["strategy"] = strategy
            continue
        rule = {"name": col, "strategy": strategy.split("-")[0]} | ({"unique": "key"} if strategy.endswith("-unique") else {}) | ({"value": "Dev"} if strategy == "static" else {})
        columns = entry.setdefault("columns", [])
        if repeated or col.lower() not in [c["name"].lower() for c in columns]:
            columns.append(rule)
    return json.dumps({"tables": list(tables.values())})


def plan() -> run_plan.RunPlan:
    return run_plan.build(catalog(), load(rule_file()))


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def query(name: str, sql: str):
    def add(f):
        RULE_QUERIES[name], RULE_SQL[name] = f, sql
        return f

    return add


_LIVE = "lower(split_part(tbl, '.', 1)) NOT IN ('sys', 'cdc', 'information_schema')"


@query(
    "inventory_columns",
    f"SELECT tbl, ord, col, nullable, NOT (computed OR identity OR generated) AS writable, kind LIKE '%char(%' OR kind = 'string' AS textual, "
    f"CASE WHEN in_key THEN CAST(count_if(in_key) OVER (PARTITION BY tbl ORDER BY ord) AS INTEGER) END AS key_ord FROM {_FACTS}",
)
def inventory_columns(spark, d):
    found = meta.inventory(spark, catalog()).where(F.lower("table") != TOOL_TABLE.lower())
    return found.select(F.col("table").alias("tbl"), F.col("ordinal").alias("ord"), F.col("column").alias("col"), "nullable", "writable", "textual", F.col("key_ordinal").alias("key_ord"))


_VERDICT = """CASE WHEN f.history_of IS NOT NULL THEN 'covered by parent' WHEN t.strategy = 'truncate' THEN 'truncated'
  WHEN r.strategy = 'keep' THEN 'kept' WHEN r.strategy IS NOT NULL AND f.col IS NOT NULL THEN 'masked'
  WHEN f.col IS NULL THEN 'no such column' WHEN f.generated THEN 'exempt' ELSE 'unclassified' END"""
_FIRST_RULES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(tbl), lower(col) ORDER BY pos) AS nth FROM {_RULES}) WHERE nth = 1 AND col IS NOT NULL)"
_TABLE_RULES = f"(SELECT * FROM {_RULES} WHERE col IS NULL)"
_VERDICTS = f"""SELECT coalesce(f.tbl, r.tbl) AS tbl, coalesce(f.col, r.col) AS col, r.strategy AS strategy, {_VERDICT} AS verdict
FROM (SELECT * FROM {_FACTS}) f FULL OUTER JOIN {_FIRST_RULES} r ON lower(f.tbl) = lower(r.tbl) AND lower(f.col) = lower(r.col)
LEFT JOIN {_TABLE_RULES} t ON lower(t.tbl) = lower(f.tbl)"""


@query("verdict_full_outer", f"SELECT * FROM ({_VERDICTS}) WHERE verdict <> 'no such column'")
def verdicts(spark, d):
    strategy = lambda r: r and r.strategy.value + "-unique" * r.unique
    rows = [(t.table.name, v.column.name, strategy(v.rule), v.kind.value) for t in plan().scrub.tables for v in t.verdicts if t.action is not Action.TOOL]
    return _frame(spark, rows, "tbl string, col string, strategy string, verdict string")


query(
    "orphan_rules",
    f"""WITH r AS (SELECT *, dense_rank() OVER (ORDER BY first_pos) - 1 AS nth FROM (SELECT *, min(pos) OVER (PARTITION BY lower(tbl)) AS first_pos FROM {_RULES}))
SELECT DISTINCT 'tables[' || CAST(nth AS VARCHAR) || '].name' AS path FROM r WHERE lower(tbl) NOT IN (SELECT lower(tbl) FROM {_FACTS})
UNION ALL SELECT f.tbl || '.' || r.col FROM r JOIN (SELECT DISTINCT tbl FROM {_FACTS}) f ON lower(f.tbl) = lower(r.tbl)
WHERE r.col IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM {_FACTS}) g WHERE lower(g.tbl) = lower(r.tbl) AND lower(g.col) = lower(r.col))""",
)(lambda spark, d: _frame(spark, [(p.path,) for p in plan().problems], "path string"))
query("unclassified_columns", f"SELECT tbl, col FROM ({_VERDICTS}) WHERE verdict = 'unclassified'")(
    lambda spark, d: _frame(spark, [(t.table.name, v.column.name) for t in plan().scrub.unclassified if t.action is not Action.TOOL for v in t.unclassified], "tbl string, col string")
)
query("plan_summary", f"SELECT verdict, count(*) AS n FROM ({_VERDICTS}) WHERE verdict <> 'no such column' AND verdict <> 'exempt' GROUP BY verdict")(
    lambda spark, d: _frame(spark, [(k.value, n) for k in Kind if k is not Kind.EXEMPT and (n := plan().scrub.count(k))], "verdict string, n long")
)
query("run_totals", f"SELECT count(DISTINCT lower(tbl)) FILTER (verdict = 'masked') AS masked_tables, count_if(verdict = 'masked')::BIGINT AS masked, count(DISTINCT lower(tbl)) FILTER (verdict = 'truncated') AS emptied FROM ({_VERDICTS})")(
    lambda spark, d: _frame(spark, [(len((p := plan()).scrub.of(Action.MASK)), p.scrub.count(Kind.MASKED), len(p.scrub.of(Action.TRUNCATE)))], "masked_tables long, masked long, emptied long")
)
query(
    "mode_per_table",
    f"""SELECT tbl, CASE WHEN bool_or(strategy IN ('email', 'scramble', 'scramble-unique')) THEN 'row by row' WHEN bool_or(has_key) THEN 'batched constant' ELSE 'whole table' END AS mode
FROM (SELECT v.*, k.has_key FROM ({_VERDICTS}) v JOIN (SELECT tbl, bool_or(in_key) AS has_key FROM {_FACTS} GROUP BY tbl) k USING (tbl)) WHERE verdict = 'masked' GROUP BY tbl""",
)(lambda spark, d: _frame(spark, [(t.table.name, t.mode.value) for t in plan().mask.tables], "tbl string, mode string"))
query("replacements", f"SELECT DISTINCT 'Dev' AS value FROM ({_VERDICTS}) WHERE strategy = 'static' AND verdict = 'masked'")(lambda spark, d: _frame(spark, [(v,) for v in plan().mask.replacements], "value string"))
query(
    "read_columns",
    f"""SELECT tbl, string_agg(col, ',' ORDER BY part, ord) AS cols FROM (
  SELECT DISTINCT f.tbl, f.col, f.ord, CASE WHEN f.in_key THEN 0 ELSE 1 END AS part FROM {_FACTS} JOIN ({_VERDICTS}) v ON v.tbl = f.tbl AND v.verdict = 'masked'
  WHERE f.in_key AND v.strategy IN ('email', 'scramble-unique') OR f.col = v.col AND v.strategy LIKE 'scramble%') GROUP BY tbl""",
)(lambda spark, d: _frame(spark, [(t.table.name, ",".join(t.read_columns)) for t in plan().mask.tables if t.read_columns], "tbl string, cols string"))
query(
    "run_steps",
    f"""SELECT 'before' AS part, 'note that nothing of the run is logged for recovery' AS step UNION ALL
SELECT DISTINCT 'before', 'stop keeping history: ' || history_of FROM {_FACTS} WHERE history_of IS NOT NULL UNION ALL SELECT DISTINCT 'before', 'empty the history: ' || tbl FROM {_FACTS} WHERE history_of IS NOT NULL UNION ALL
SELECT 'before', 'empty the table: ' || tbl FROM {_RULES} WHERE strategy = 'truncate' UNION ALL SELECT DISTINCT 'after', 'keep history again: ' || history_of FROM {_FACTS} WHERE history_of IS NOT NULL""",
)(lambda spark, d: _frame(spark, [("before", str(s)) for s in plan().before] + [("after", str(s)) for s in plan().after], "part string, step string"))
query("history_lookup", f"SELECT DISTINCT p.tbl, h.tbl AS history FROM {_FACTS.replace('AS f(', 'AS p(')} LEFT JOIN (SELECT * FROM {_FACTS}) h ON h.history_of = p.tbl WHERE p.history_of IS NULL")(
    lambda spark, d: _frame(spark, [(t.name, t.history) for t in _live(catalog())], "tbl string, history string")
)
query("live_tables", f"SELECT DISTINCT tbl FROM {_FACTS} WHERE tbl NOT IN (SELECT tbl FROM {_FACTS} WHERE history_of IS NOT NULL)")(lambda spark, d: _frame(spark, [(t.name,) for t in _live(catalog())], "tbl string"))


def _live(c: Catalog) -> list[TableMeta]:
    """Tables but those that keep another's history, and the tool's own."""
    return [t for t in c.tables if t.name.lower() not in c.history_names and t.name.lower() != TOOL_TABLE.lower()]


query("covered_tables", f"SELECT DISTINCT tbl FROM {_FACTS} WHERE lower(tbl) IN (SELECT lower(tbl) FROM {_RULES})")(
    lambda spark, d: _frame(spark, [(t.table.name,) for t in plan().scrub.tables if t.rule is not None], "tbl string")
)
query("columns_per_table_listagg", f"SELECT tbl, count(*) AS n, string_agg(col, ', ' ORDER BY ord) AS cols FROM {_FACTS} GROUP BY tbl")(
    lambda spark, d: inventory_columns(spark, d).groupBy("tbl").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "col"))), lambda x: x["col"]), ", ").alias("cols"))
)
query("key_columns_in_order", f"SELECT tbl, string_agg(col, ',' ORDER BY ord) AS key FROM {_FACTS} WHERE in_key GROUP BY tbl")(
    lambda spark, d: _frame(spark, [(t.name, ",".join(k.name for k in t.key_columns)) for t in catalog().tables if t.primary_key], "tbl string, key string")
)


def _problems(text: str) -> list:
    try:
        load(text)
    except InvalidRules as e:
        return e.problems
    return []


query(
    "duplicate_rules",
    f"""SELECT 'DBS008' AS code, 'tables[' || CAST(t AS VARCHAR) || '].columns[' || CAST(c AS VARCHAR) || '].name' AS path FROM (
  SELECT *, dense_rank() OVER (ORDER BY first_tbl) - 1 AS t, row_number() OVER (PARTITION BY lower(tbl) ORDER BY pos) - 1 AS c, min(pos) OVER (PARTITION BY lower(tbl), lower(col)) AS first_pos
  FROM (SELECT *, min(pos) OVER (PARTITION BY lower(tbl)) AS first_tbl FROM {_RULES})) WHERE pos > first_pos""",
)(lambda spark, d: _frame(spark, [(p.code, p.path) for p in _problems(rule_file(repeated=True))], "code string, path string"))

#: Faulty rule files, and the codes and places of what is wrong with each.
FAULTY = [
    ("{", "DBS001 (1,2)"), ("[]", "DBS004 (1,1)"), ("{}", "DBS003 (1,1)"), ('{"tables": {}}', "DBS004 (1,12)"), ('{"tables": [{"name": "a.b"}]}', "DBS009 (1,13)"),
    ('{"tables": [{"name": "a.b", "strategy": "keep"}]}', "DBS003 (1,13)"), ('{"tables": [{"name": "b", "strategy": "truncate"}]}', "DBS005 (1,22)"),
    ('{"tables": [\n{"name": "a.b", "columns": [{"name": "x"}]}]}', "DBS003 (2,29)"), ('{"tables": [], "defaults": {"batchSize": 0}}', "DBS005 (1,42)"),
    ('{"tables": [\n{"name": "a.b", "columns": [{"name": "x", "strategy": "static"}]}]}', "DBS006 (2,29)"),
]
_FILES = _values([(i, t) for i, (t, _) in enumerate(FAULTY)], ["id", "text"], "f")
query("config_problems", f"SELECT id, problem FROM {_values([(i, p) for i, (_, p) in enumerate(FAULTY)], ['id', 'problem'], 'p')}")(
    lambda spark, d: _frame(spark, [(i, "; ".join(f"{p.code} ({p.line},{p.column})" for p in _problems(t))) for i, (t, _) in enumerate(FAULTY)], "id int, problem string")
)
query("config_hash", f"SELECT sha256({_literal(rule_file())}) AS hash")(lambda spark, d: _frame(spark, [(load(rule_file()).hash,)], "hash string"))
query("unique_rules_grouped", f"SELECT tbl, count(*) AS n, string_agg(idx || '(' || cols || ')', '; ' ORDER BY idx) AS rules FROM (SELECT tbl, idx, string_agg(col, ',' ORDER BY ord) AS cols FROM {_values(INDEXES, ['tbl', 'idx', 'ord', 'col'], 'i')} GROUP BY tbl, idx) GROUP BY tbl")(
    lambda spark, d: _frame(spark, [(t.name, len(t.unique_rules), "; ".join(f"{u.name}({','.join(u.columns)})" for u in sorted(t.unique_rules, key=lambda u: u.name))) for t in catalog(indexes=True).tables if t.unique_rules], "tbl string, n long, rules string")
)
query(
    "unclassified_summary",
    f"SELECT n, kind FROM (SELECT split_part(hint, ': ', 2) AS kind, count(*) AS n FROM (SELECT {'{hint}'} AS hint FROM (SELECT {'{tokens}'} AS t FROM ({_VERDICTS}) WHERE verdict = 'unclassified')) WHERE hint IS NOT NULL GROUP BY ALL)",
)(lambda spark, d: _frame(spark, [(int(n), kind) for n, kind in (line.split(" x ") for line in report.summary(plan().scrub.unclassified) if " x " in line)], "n long, kind string"))


# Names and hints

_NAMES = _values([(i, n) for i, n in enumerate(COLUMN_NAMES)], ["id", "name"], "n")
_TOKENS = r"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'), '([\p{L}\p{Nd}])(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"""


def _list(words) -> str:
    return "[" + ", ".join(_literal(w) for w in words) + "]"


def _first_of(kinds: dict[str, str]) -> str:
    return f"(CASE list_filter(t, lambda x: list_contains({_list(kinds)}, x))[1] {' '.join(f'WHEN {_literal(k)} THEN {_literal(v)}' for k, v in kinds.items())} END)"


_NUMBERED = f"list_contains(t, 'number') AND list_has_any(t, {_list(names.NUMBER_OF)})"
_HINT = f"""CASE WHEN len(t) = 0 OR list_contains({_list(names.SETTING_FIRST)}, t[1]) THEN NULL
  WHEN {_NUMBERED} THEN 'strong: ' || CASE {' '.join(f'WHEN list_contains(t, {_literal(w)}) THEN {_literal(k)}' for w, k in names.NUMBER_OF.items())} END
  WHEN list_has_any(t, {_list(names.ABOUT_THE_RECORD)}) THEN NULL
  WHEN list_has_any(t, {_list(names.STRONG)}) THEN 'strong: ' || {_first_of(names.STRONG)}
  WHEN list_contains(t, 'name') AND list_has_any(t, {_list(names.NAME_QUALIFIERS)}) THEN 'strong: ' || {_literal(names.PERSON)}
  WHEN list_has_any(t, {_list(names.WEAK)}) THEN 'weak: ' || {_first_of(names.WEAK)} ELSE NULL END"""


def _hint_text(name: Column) -> Column:
    h = names.hint(name)
    return F.when(h.isNotNull(), F.concat(h["strength"], F.lit(": "), h["kind"]))


query("name_tokens", f"SELECT id, name, array_to_string({_TOKENS}, ' ') AS tokens FROM {_NAMES}")(lambda spark, d: _relation(spark, _NAMES).select("id", "name", F.array_join(names.tokens(F.col("name")), " ").alias("tokens")))
query("name_hints", f"SELECT id, name, {_HINT} AS hint FROM (SELECT id, name, {_TOKENS} AS t FROM {_NAMES})")(lambda spark, d: _relation(spark, _NAMES).select("id", "name", _hint_text(F.col("name")).alias("hint")))
query("hint_kinds", f"SELECT hint, count(*) AS n FROM (SELECT {_HINT} AS hint FROM (SELECT {_TOKENS} AS t FROM {_NAMES})) WHERE hint IS NOT NULL GROUP BY hint ORDER BY n DESC, hint")(
    lambda spark, d: _relation(spark, _NAMES).select(_hint_text(F.col("name")).alias("hint")).where("hint IS NOT NULL").groupBy("hint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hint")
)

RULE_SQL["unclassified_summary"] = RULE_SQL["unclassified_summary"].replace("{hint}", _HINT).replace("{tokens}", _TOKENS.replace("(name,", "(col,"))
_HINTED = f"SELECT tbl, ord, col, {_HINT} AS hint FROM (SELECT tbl, ord, col, {_TOKENS.replace('(name,', '(col,')} AS t FROM {_FACTS} WHERE history_of IS NULL)"


@query(
    "top_tables_by_hints",
    f"""SELECT tbl, n, CASE WHEN n > 6 THEN cols || ' +' || CAST(n - 6 AS VARCHAR) || ' more' ELSE cols END AS cols FROM (
  SELECT tbl, max(n) AS n, count_if(hint LIKE 'strong%') AS strong, string_agg(col, ', ' ORDER BY ord) AS cols FROM (
    SELECT *, count(*) OVER (PARTITION BY tbl) AS n, row_number() OVER (PARTITION BY tbl ORDER BY ord) AS nth FROM ({_HINTED}) WHERE hint IS NOT NULL) WHERE nth <= 6 GROUP BY tbl
) ORDER BY strong DESC, tbl LIMIT 12""",
)
def top_tables_by_hints(spark, d):
    """The 12 tables with the most strong hints, and the first 6 columns of each."""
    w = Window.partitionBy("tbl")
    hinted = inventory_columns(spark, d).where(F.col("tbl") != "dbo.PersonHistory").withColumn("hint", _hint_text(F.col("col"))).where("hint IS NOT NULL")
    ranked = hinted.withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("ord"))}).where("nth <= 6")
    cols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "col"))), lambda x: x["col"]), ", ")
    best = ranked.groupBy("tbl").agg(F.max("n").alias("n"), F.count_if(F.col("hint").startswith("strong")).alias("strong"), cols.alias("cols")).orderBy(F.desc("strong"), "tbl").limit(12)
    return best.select("tbl", "n", F.when(F.col("n") > 6, F.concat("cols", F.lit(" +"), (F.col("n") - 6).cast("string"), F.lit(" more"))).otherwise(F.col("cols")).alias("cols"))


_TYPOS, _KNOWN = _values([(i, t) for i, t in enumerate(TYPOS)], ["id", "given"], "t"), _values([(i, k) for i, k in enumerate(KNOWN)], ["pos", "known"], "k")


query(
    "typo_suggest",
    f"""SELECT id, given, CASE WHEN distance <= 2 THEN known END AS known FROM (SELECT id, given, known, levenshtein(lower(given), lower(known)) AS distance, row_number() OVER (PARTITION BY id ORDER BY levenshtein(lower(given), lower(known)), pos) AS nth
FROM {_TYPOS}, {_KNOWN}) WHERE nth = 1""",
)(lambda spark, d: _frame(spark, [(i, t, nearest(t, tuple(KNOWN))) for i, t in enumerate(TYPOS)], "id int, given string, known string"))


_STAMPS = _values([(i, s) for i, s in enumerate(STAMPS)], ["id", "value"], "s")


query("stamp_interpret", f"SELECT id, coalesce(lower(trim(value)) IN ('true', '1'), false) AS stamped FROM {_STAMPS}")(
    lambda spark, d: _frame(spark, [(i, stamp.interpret({stamp.SANITIZED: v}).sanitized) for i, v in enumerate(STAMPS)], "id int, stamped boolean")
)
query("qualified_names", f"SELECT DISTINCT split_part(tbl, '.', 1) AS schema_name, split_part(tbl, '.', 2) AS table_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(tbl) ORDER BY pos) AS nth FROM {_RULES}) WHERE nth = 1")(
    lambda spark, d: _frame(spark, [(t.schema, t.table) for t in load(rule_file()).tables], "schema_name string, table_name string")
)
query("all_names", f"SELECT lower(tbl) AS tbl FROM {_FACTS} UNION SELECT lower(tbl) FROM {_RULES}")(
    lambda spark, d: _frame(spark, [(t.name.lower(),) for t in catalog().tables if t.name.lower() != TOOL_TABLE.lower()], "tbl string").union(_frame(spark, [(t.name.lower(),) for t in load(rule_file()).tables], "tbl string")).distinct()
)
query("rules_without_table", f"SELECT DISTINCT lower(tbl) AS tbl FROM {_RULES} EXCEPT SELECT lower(tbl) FROM {_FACTS}")(
    lambda spark, d: _frame(spark, [(t.name.lower(),) for t in load(rule_file()).tables], "tbl string").exceptAll(_frame(spark, [(t.name.lower(),) for t in catalog().tables], "tbl string"))
)

# Safety, keys, dates and values

SERVERS = ["localhost", "LOCALHOST", ".", "(local)", "127.0.0.1", " localhost ", "prod-sql-01", "10.0.0.5", "localhost.evil.example", "notlocalhost", "localhost2", "", "localhost\\X", ".\\X", "10.0.0.5\\SQL2022", "prod-sql-01\\localhost", None]
TYPED = [("db", "db"), (" db ", "db"), ("DB", "db"), ("", ""), ("db2", "db"), (None, "db")]
DATES = ["2026-08-03", "2026-08-03 10:11:12", "1970-01-01 00:00:00", "someday", "", "2026-13-01", None]
WRITTEN = ["42", "-1", "255", "99999", "1.5", "12.34", "true", "last Tuesday", "1970-01-01", "", None]
GUIDS = [("6F9619FF-8B86-D011-B42D-00C04FC964FF", 7), ("6f9619ff-8b86-d011-b42d-00c04fc964ff", 7), ("00000000-0000-0000-0000-000000000000", 1)]

_SERVERS = _values([(i, s) for i, s in enumerate(SERVERS)], ["id", "server"], "s")
_TYPED = _values([(i, *t) for i, t in enumerate(TYPED)], ["id", "typed", "name"], "t")
_DATES = _values([(i, s) for i, s in enumerate(DATES)], ["id", "value"], "d")
_WRITTEN = _values([(i, s) for i, s in enumerate(WRITTEN)], ["id", "value"], "w")
_GUIDS = _values(GUIDS, ["guid", "part"], "g")


query(
    "server_allowlist",
    f"SELECT id, coalesce(lower(trim(server)) IN ('localhost', '.', '(local)', '127.0.0.1'), false) AS allowed, coalesce(lower(split_part(trim(server), '\\', 1)) IN ('localhost', '.', '127.0.0.1'), false) AS unattended FROM {_SERVERS}",
)(lambda spark, d: _frame(spark, [(i, safety.allowed(s, ALLOWED_SERVERS), safety.unattended(s)) for i, s in enumerate(SERVERS)], "id int, allowed boolean, unattended boolean"))
query("typed_confirmation", f"SELECT id, coalesce(trim(typed) = trim(name) AND trim(typed) <> '', false) AS confirmed FROM {_TYPED}")(
    lambda spark, d: _frame(spark, [(i, safety.confirmed(*t)) for i, t in enumerate(TYPED)], "id int, confirmed boolean")
)


def _stamped_at(value: str | None) -> str | None:
    when = stamp.interpret({stamp.SANITIZED_UTC: value}).when
    return when and when.strftime("%Y-%m-%d %H:%M:%S")


query("stamp_dates", f"SELECT id, strftime(try_cast(value AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamped_at FROM {_DATES}")(
    lambda spark, d: _frame(spark, [(i, _stamped_at(v)) for i, v in enumerate(DATES)], "id int, stamped_at string")
)


def _converted(kind: str, text: str | None, type_: T.DataType, **facts) -> str | None:
    """What a value as written becomes in a column of the type; null where it is refused."""
    try:
        return None if text is None else str(convert(StaticSpec(kind, text), ColumnMeta("c", type_, **facts)))
    except Refused:
        return None


query(
    "static_values",
    f"""SELECT id, CASE WHEN regexp_matches(value, '^-?[0-9]+$') THEN CAST(try_cast(value AS SMALLINT) AS VARCHAR) END AS small,
  CASE WHEN regexp_matches(value, '^[0-9]+$') AND try_cast(value AS BIGINT) <= 255 THEN CAST(try_cast(value AS SMALLINT) AS VARCHAR) END AS tiny,
  CASE WHEN regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$') THEN try_cast(value AS DOUBLE) END AS number, CASE WHEN value IN ('true', 'false', '1', '0') THEN value IN ('true', '1') END AS flag,
  CASE WHEN regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(try_cast(value AS DATE) AS VARCHAR) END AS day, CASE WHEN length(value) <= 5 THEN value END AS short FROM {_WRITTEN}""",
)(
    lambda spark, d: _frame(
        spark,
        [
            (
                i, _converted("number", v, T.ShortType()), _converted("number", v, T.ByteType(), unsigned=True), n and float(n), f and f == "True",
                _converted("string", v, T.DateType()), _converted("string", v, T.StringType(), max_length=5),
            )
            for i, v in enumerate(WRITTEN)
            for n in [_converted("number", v, T.DoubleType()) if v and v.lstrip("-")[:1].isdigit() and "-" not in v[1:] else None]
            for f in [_converted("boolean", v, T.BooleanType())]
        ],
        "id int, small string, tiny string, number double, flag boolean, day string, short string",
    )
)


@query("guid_keys", f"SELECT guid, replace(lower(guid), '-', '') || '-' || CAST(part AS VARCHAR) AS key, 'fakeemail' || replace(lower(guid), '-', '') || '-' || CAST(part AS VARCHAR) || '@notreal.invalid' AS email FROM {_GUIDS}")
def guid_keys(spark, d):
    from sparkmask.functions import masking

    key = masking.discriminator([F.col("guid"), F.col("part")], [True, False])
    return _relation(spark, _GUIDS).select("guid", key.alias("key"), masking.generated_email(key).alias("email"))


@query(
    "excused_by_join",
    "SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0)",
)
def excused_by_join(spark, d):
    """Values that no long list of constants excuses: the anti join that replaces a list where it is large."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    return df.join(df.where("c_custkey % 3 = 0").select("c_name"), "c_name", "left_anti").select("c_custkey", "c_name")


query("system_schemas", f"SELECT DISTINCT tbl FROM (SELECT tbl FROM {_FACTS} UNION ALL VALUES {', '.join(f'({_literal(n)})' for n in SYSTEM)}) WHERE {_LIVE}")(
    lambda spark, d: _frame(spark, [(t.name,) for t in catalog().tables], "tbl string")
)
query(
    "usable_keys",
    f"SELECT tbl, bool_and(kind IN ('tinyint', 'smallint', 'int', 'bigint')) AS spliceable, CAST(sum(CASE kind WHEN 'tinyint' THEN 3 WHEN 'smallint' THEN 6 WHEN 'int' THEN 11 WHEN 'bigint' THEN 20 ELSE 32 END) + count(*) - 1 AS BIGINT) AS width FROM {_FACTS} WHERE in_key GROUP BY tbl",
)(lambda spark, d: _frame(spark, [(t.name, all(map(keys.spliceable, t.key_columns)), keys.max_width(t.key_columns)) for t in catalog().tables if t.primary_key], "tbl string, spliceable boolean, width long"))
