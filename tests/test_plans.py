import json

import pytest
from pyspark.sql import types as T

from sparkmask.plans import masker, report, run_plan, safety
from sparkmask.plans.meta import Catalog, ColumnMeta, TableMeta, Temporal, UniqueRule
from sparkmask.plans.rules import InvalidRules, StaticSpec, Strategy, load
from sparkmask.plans.static_value import Refused, convert
from sparkmask.plans.verdicts import Action, Kind, resolve

S, I = T.StringType(), T.IntegerType()


def col(name, kind=S, **k):
    return ColumnMeta(name, kind, **{"max_length": 100 if isinstance(kind, T.StringType) else None} | k)


def person(**k):
    columns = (col("PersonId", I, nullable=False, identity=True), col("FirstName"), col("LastName"), col("Email", nullable=False), col("Ssn", max_length=11), col("FullName", computed="concat(FirstName, ' ', LastName)"), col("ValidFrom", T.TimestampNTZType(), generated=True))
    return TableMeta("dbo.Person", columns, ("PersonId",), **k)


def plan(tables, rules, **k):
    return run_plan.build(Catalog("db", tuple(tables)), load(json.dumps({"tables": rules})), **k)


def codes(text):
    with pytest.raises(InvalidRules) as e:
        load(text if isinstance(text, str) else json.dumps(text))
    return [p.code for p in e.value.problems]


def table(**k):
    return {"tables": [{"name": "a.b", **k}]}


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("{", ["DBS001"]), ("[]", ["DBS004"]), ({}, ["DBS003"]), ({"tables": {}}, ["DBS004"]), ({"tabels": []}, ["DBS002", "DBS003"]),
        (table(), ["DBS009"]), (table(strategy="truncate", columns=[{"name": "x", "strategy": "null"}]), ["DBS009"]), (table(strategy="keep"), ["DBS003"]),
        (table(stragety="truncate"), ["DBS002", "DBS009"]), (table(columns=[{"name": "x"}]), ["DBS003"]), (table(columns=[{"name": "x", "strategy": "wipe"}]), ["DBS005"]),
        (table(columns=[{"name": "x", "strategy": "static"}]), ["DBS006"]), (table(columns=[{"name": "x", "strategy": "scramble", "value": 1}]), ["DBS007"]),
        (table(columns=[{"name": "x", "strategy": "static", "value": None}]), ["DBS005"]), (table(columns=[{"name": "x", "strategy": "static", "value": []}]), ["DBS004"]),
        (table(columns=[{"name": "x", "strategy": "null"}, {"name": "X", "strategy": "null"}]), ["DBS008"]), (table(columns=[{"name": "x", "strategy": "email", "unique": "key"}]), ["DBS009"]),
        (table(columns=[{"name": "x", "strategy": "scramble", "unique": "row"}]), ["DBS005"]), ({"tables": [{"name": "b", "strategy": "truncate"}]}, ["DBS005"]),
        ({"tables": [{"name": "a.b", "strategy": "truncate"}, {"name": "A.B", "strategy": "truncate"}]}, ["DBS008"]), ({"defaults": {"allowedServers": []}, "tables": []}, ["DBS005"]),
        ({"defaults": {"batchSize": 0}, "tables": []}, ["DBS005"]), ({"defaults": {"batchSize": "5"}, "tables": []}, ["DBS004"]), ({"defaults": {"batchSize": 1000001}, "tables": []}, ["DBS005"]),
    ],
)
def test_problems_of_rule_files(given, expected):
    assert codes(given) == expected


def test_all_problems_are_told_with_their_place():
    with pytest.raises(InvalidRules) as e:
        load('{\n  "tables": [\n    {"name": "é.b", "stragety": "truncate", "columns": [{"name": "x", "strategy": "static"}]}\n  ]\n}')
    first, second = e.value.problems
    assert (first.code, first.line, first.column) == ("DBS002", 3, 22) and "strategy" in first.fix
    assert second.code == "DBS006" and second.path == "tables[0].columns[0]"


def test_comments_and_trailing_commas():
    rules = load('// one\n{"$comment": "x", "tables": [ /* two */ {"name": "a.b", "strategy": "truncate",}, ], "defaults": {"unclassifiedColumns": "fail"}}')
    assert rules.tables[0].name == "a.b" and rules.unclassified.value == "fail" and rules.batch_size == 5000


def test_every_column_has_one_verdict():
    rules = [{"name": "DBO.person", "columns": [{"name": "firstname", "strategy": "static", "value": "Dev"}, {"name": "personid", "strategy": "keep"}, {"name": "Gone", "strategy": "null"}]}, {"name": "dbo.Nowhere", "strategy": "truncate"}]
    scrub = plan([person()], rules).scrub
    kinds = {v.column.name: v.kind for v in scrub.tables[0].verdicts}
    assert kinds == {"PersonId": Kind.KEPT, "FirstName": Kind.MASKED, "LastName": Kind.UNCLASSIFIED, "Email": Kind.UNCLASSIFIED, "Ssn": Kind.UNCLASSIFIED, "FullName": Kind.UNCLASSIFIED, "ValidFrom": Kind.EXEMPT}
    assert sorted(p.path for p in scrub.problems) == ["dbo.Person.Gone", "tables[1].name"]


def test_computed_columns_can_be_exempt():
    scrub = resolve(Catalog("db", (person(),)), load('{"tables": []}'), exempt_computed=True)
    assert {v.column.name for v in scrub.tables[0].verdicts if v.kind is Kind.EXEMPT} == {"FullName", "ValidFrom"}
    assert scrub.tables[0].action is Action.UNTOUCHED


@pytest.mark.parametrize(
    ("column", "rule", "word"),
    [
        ("PersonId", {"strategy": "null"}, "primary key"), ("Email", {"strategy": "null"}, "nulls"), ("FullName", {"strategy": "scramble"}, "computed"),
        ("ValidFrom", {"strategy": "null"}, "period"), ("Ssn", {"strategy": "static", "value": "far too long for it"}, "11 characters"), ("Ssn", {"strategy": "email"}, "needs 36"),
        ("Ssn", {"strategy": "scramble", "unique": "key"}, "needs 12"), ("LastName", {"strategy": "static", "value": 5}, "quotes"),
    ],
)
def test_refusals(column, rule, word):
    problems = plan([person()], [{"name": "dbo.Person", "columns": [{"name": column, **rule}]}]).problems
    assert len(problems) == 1 and word in str(problems[0])


@pytest.mark.parametrize(("rule", "ok"), [({"strategy": "static", "value": "x"}, False), ({"strategy": "null"}, False), ({"strategy": "scramble"}, False), ({"strategy": "scramble", "unique": "key"}, True), ({"strategy": "email"}, True), ({"strategy": "keep"}, True)])
def test_unique_columns(rule, ok):
    t = person(unique_rules=(UniqueRule("ux", ("FirstName", "lastname")),))
    assert (not plan([t], [{"name": "dbo.Person", "columns": [{"name": "LastName", **rule}]}]).problems) is ok


def test_modes_and_keyless_tables():
    heap = TableMeta("dbo.Heap", (col("Email"), col("Notes")))
    mode = lambda t, *r: plan([t], [{"name": t.name, "columns": [{"name": n, "strategy": s, **({"value": "x"} if s == "static" else {})} for n, s in r]}])
    assert mode(heap, ("Email", "static"), ("Notes", "null")).mask.tables[0].mode is masker.Mode.WHOLE_TABLE
    assert mode(person(), ("FirstName", "static")).mask.tables[0].mode is masker.Mode.BATCHED_CONSTANT
    assert mode(person(), ("FirstName", "static"), ("LastName", "scramble")).mask.tables[0].mode is masker.Mode.ROW_BY_ROW
    assert "no primary key" in str(mode(heap, ("Notes", "scramble")).problems[0])
    loose = run_plan.build(Catalog("db", (heap,)), load(json.dumps({"tables": [{"name": "dbo.Heap", "columns": [{"name": "Notes", "strategy": "scramble"}]}]})), strict=False)
    assert not loose.problems and loose.mask.tables[0].read_columns == ("Notes",)


@pytest.mark.parametrize(("kind", "ok"), [(I, True), (T.LongType(), True), (S, False), (T.DecimalType(9, 0), False), (T.BinaryType(), False)])
def test_keys_that_make_addresses(kind, ok):
    t = TableMeta("a.t", (ColumnMeta("k", kind, False), col("e")), ("k",))
    assert (not plan([t], [{"name": "a.t", "columns": [{"name": "e", "strategy": "email"}]}]).problems) is ok


def test_uuid_keys_make_addresses_but_no_tails():
    t = TableMeta("a.t", (ColumnMeta("k", S, False, uuid=True), col("e")), ("k",))
    assert not plan([t], [{"name": "a.t", "columns": [{"name": "e", "strategy": "email"}]}]).problems
    assert plan([t], [{"name": "a.t", "columns": [{"name": "e", "strategy": "scramble", "unique": "key"}]}]).problems


def test_steps_and_history():
    old = TableMeta("dbo.PersonHistory", (col("LastName"),), temporal=Temporal.HISTORY)
    parent = person(temporal=Temporal.VERSIONED, history="dbo.PersonHistory")
    kinds = lambda p: [s.kind.name for s in p.before]
    nothing = run_plan.build(Catalog("db", (parent, old), change_feed=True), load('{"tables": []}'))
    assert kinds(nothing) == ["SIMPLE_RECOVERY", "DROP_CHANGE_FEED", "DETACH_HISTORY", "EMPTY_HISTORY"]
    assert [s.kind.name for s in nothing.after] == ["REATTACH_HISTORY"]
    rule = {"name": "dbo.Person", "history": "mask", "columns": [{"name": "LastName", "strategy": "scramble"}]}
    masks = plan([parent, old], [rule], strict=False)
    assert [t.table.name for t in masks.mask.tables] == ["dbo.Person", "dbo.PersonHistory"] and kinds(masks) == ["SIMPLE_RECOVERY", "DETACH_HISTORY"]
    assert "history" in str(plan([parent], [rule]).problems[0])
    assert plan([parent, old], [{"name": "dbo.PersonHistory", "strategy": "truncate"}]).problems


SMALL, TINY = ColumnMeta("c", T.ShortType()), ColumnMeta("c", T.ShortType(), unsigned=True)


@pytest.mark.parametrize(
    ("spec", "column", "out"),
    [
        (("string", "x" * 10), col("c", max_length=10), "x" * 10), (("string", "x" * 11), col("c", max_length=10), None), (("number", "5"), col("c"), None), (("number", "42"), SMALL, 42),
        (("number", "255"), TINY, 255), (("number", "-1"), TINY, None), (("number", "99999"), SMALL, None), (("number", "1.5"), col("c", I), None), (("string", "42"), col("c", I), None),
        (("number", "12.34"), col("c", T.DoubleType()), 12.34), (("boolean", "true"), col("c", T.BooleanType()), True), (("number", "0"), col("c", T.BooleanType()), False),
        (("string", "true"), col("c", T.BooleanType()), None), (("string", "last Tuesday"), col("c", T.DateType()), None), (("string", "x"), col("c", T.BinaryType()), None),
        (("string", "00000000-0000-0000-0000-000000000000"), col("c", uuid=True), "00000000-0000-0000-0000-000000000000"), (("string", "zero"), col("c", uuid=True), None),
    ],
)
def test_static_values(spec, column, out):
    if out is None:
        with pytest.raises(Refused):
            convert(StaticSpec(*spec), column)
    else:
        assert convert(StaticSpec(*spec), column) == out


def test_dates():
    assert str(convert(StaticSpec("string", "1970-01-01"), col("c", T.DateType()))) == "1970-01-01"
    assert convert(StaticSpec("string", "1970-01-01T00:00:00+02:00"), col("c", T.TimestampType())).utcoffset().seconds == 7200


def test_servers():
    allowed = ["localhost", ".", "(local)", "127.0.0.1"]
    assert all(safety.allowed(s, allowed) for s in ("localhost", "LOCALHOST", ".", "(local)", "127.0.0.1", " localhost "))
    assert not any(safety.allowed(s, allowed) for s in ("prod-sql-01", "10.0.0.5", "localhost.evil.example", "notlocalhost", "localhost2", "", " ", None))
    assert all(map(safety.unattended, ("localhost\\X", ".\\X", "127.0.0.1\\X", "localhost")))
    assert not any(map(safety.unattended, ("(local)", "127.0.0.2", "localhost.corp.example", "10.0.0.5\\SQL2022", "prod-sql-01\\localhost", "")))
    assert safety.confirmed(" db ", "db") and not safety.confirmed("DB", "db") and not safety.confirmed("", "") and not safety.confirmed(None, "db")


def test_pasted_rules_resolve_every_column():
    first = plan([person(), TableMeta("app.Other", (col("Name"),))], [{"name": "dbo.Person", "columns": [{"name": "PersonId", "strategy": "keep"}]}])
    own, new = sorted(first.scrub.unclassified, key=lambda t: t.rule is None)
    rules = [{"name": "dbo.Person", "columns": [{"name": "PersonId", "strategy": "keep"}, *json.loads(f"[{report.entry(own)}]")]}, json.loads(report.entry(new))]
    assert not plan([person(), TableMeta("app.Other", (col("Name"),))], rules).scrub.unclassified


def test_summary_of_many_columns():
    t = TableMeta("dbo.Wide", tuple(col(n) for n in ["FirstName", "LastName", "HomePhone", "Email", "Ssn", "Notes", "City"] + [f"Plain{i}" for i in range(60)]))
    text = report.render(plan([t, TableMeta("dbo.Quiet", (col("Plain"),))], []))
    assert "+1 more" in text and "--review-all" in text and "2 x a person's name" in text and "Plain7" not in text
    assert "Plain7" in report.render(plan([t], []), review_all=True)


def test_replacements_are_static_texts():
    p = plan([person()], [{"name": "dbo.Person", "columns": [{"name": "FirstName", "strategy": "static", "value": "Dev"}, {"name": "LastName", "strategy": "static", "value": ""}, {"name": "Ssn", "strategy": "scramble"}]}])
    assert p.mask.replacements == {"Dev"}
    assert [c.strategy for c in p.mask.tables[0].columns] == [Strategy.STATIC, Strategy.STATIC, Strategy.SCRAMBLE]
