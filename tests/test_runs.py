import datetime as dt
import io
import json

import pytest
from pyspark.sql import functions as F

from sparkmask import cli
from sparkmask.operators import keyset, runner, stamp, sweep
from sparkmask.plans import run_plan
from sparkmask.plans.rules import load
from sparkmask.sources.dataset import Dataset, Folder
from sparkmask.streaming import stream
from tests.conftest import rows

FACTS = {
    "changeFeed": True,
    "tables": {
        "dbo.Person": {"primaryKey": ["PersonId"], "history": "dbo.PersonHistory", "columns": {"FullName": {"computed": "concat_ws(' ', FirstName, LastName)"}}},
        "dbo.PersonHistory": {"temporal": "history"},
        "app.Membership": {"primaryKey": ["OrganizationId", "MemberNumber"], "unique": {"ux_user": ["Username"], "ux_mail": ["Email"]}},
        "dbo.LoginAudit": {"primaryKey": ["Id"]},
    },
}
RULES = [
    {
        "name": "dbo.Person",
        "columns": [
            {"name": "PersonId", "strategy": "keep"},
            {"name": "FirstName", "strategy": "static", "value": "Dev"},
            {"name": "LastName", "strategy": "scramble", "unique": "key"},
            {"name": "Email", "strategy": "email"},
            {"name": "Ssn", "strategy": "scramble"},
            {"name": "Notes", "strategy": "static", "value": "[redacted]"},
            {"name": "FullName", "strategy": "keep", "reason": "computed"},
        ],
    },
    {
        "name": "app.Membership",
        "columns": [
            {"name": "OrganizationId", "strategy": "keep"},
            {"name": "MemberNumber", "strategy": "keep"},
            {"name": "Username", "strategy": "scramble", "unique": "key"},
            {"name": "Email", "strategy": "email"},
        ],
    },
    {"name": "dbo.LoginAudit", "strategy": "truncate"},
    {"name": "dbo.ContactImport", "columns": [{"name": "Email", "strategy": "static", "value": "dev@example.invalid"}, {"name": "Phone", "strategy": "null"}]},
]


def config(rules=None, **defaults):
    return json.dumps({"defaults": {"unclassifiedColumns": "fail"} | defaults, "tables": rules or RULES})


@pytest.fixture
def dataset(spark, tmp_path):
    root = tmp_path / "db"
    tables = {
        "dbo.Person": ([(1, "Ada", "Lovelace", "ada@example.invalid", "123-45-6789", "call 212-555-0100", "Ada Lovelace"), (2, "Li", None, "li@example.invalid", None, None, "Li")], "PersonId int, FirstName string, LastName string, Email string, Ssn string, Notes string, FullName string"),
        "dbo.PersonHistory": ([(1, "Byron")], "PersonId int, LastName string"),
        "app.Membership": ([(1, 100, "alovelace", "a@example.invalid"), (1, 101, "ali", "b@example.invalid"), (2, 100, "alovelace2", "c@example.invalid")], "OrganizationId int, MemberNumber int, Username string, Email string"),
        "dbo.LoginAudit": ([(1, "ada@example.invalid")], "Id long, Payload string"),
        "dbo.ContactImport": ([("x@example.invalid", "212.555.0100"), ("x@example.invalid", "212.555.0100")], "Email string, Phone string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    (root / "_facts.json").write_text(json.dumps(FACTS))
    return Dataset(spark, str(root))


def run(dataset, text):
    rules = load(text)
    return runner.run(dataset, run_plan.build(dataset.catalog(), rules), rules.hash)


def test_run_masks_verifies_and_stamps(spark, dataset):
    outcome = run(dataset, config())
    assert outcome.succeeded, (outcome.error, outcome.verify)
    person = {r["PersonId"]: r for r in dataset.table("dbo.Person").collect()}
    assert person[1]["Email"] == "fakeemail1@notreal.invalid" and person[1]["LastName"] == "Xxxxxx#1" and person[1]["FullName"] == "Dev Xxxxxx#1"
    assert person[2]["LastName"] is None and person[2]["Notes"] == "[redacted]" and person[2]["Ssn"] is None
    members = rows(dataset.table("app.Membership").select("OrganizationId", "MemberNumber", "Username", "Email"))
    assert members[0] == (1, 100, "xxx#1-100", "fakeemail1-100@notreal.invalid") and members[1][2] == "#1-101"
    assert dataset.table("dbo.LoginAudit").count() == 0 and dataset.table("dbo.PersonHistory").count() == 0
    assert rows(dataset.table("dbo.ContactImport")) == [("dev@example.invalid", None)] * 2
    steps = ["verify", "delete old rows", "keep history again: dbo.Person", "stamp"]
    assert [s for s in outcome.steps if s in steps] == steps
    assert stamp.read(dataset.folder).sanitized and stamp.audit(dataset.folder).count() == 1
    assert [n for n in dataset.folder.names() if "staging" in n] == []


def test_a_leak_blocks_publishing_and_the_stamp(spark, dataset):
    leaky = [dict(t) for t in RULES]
    leaky[0]["columns"] = [c if c["name"] != "Notes" else {"name": "Notes", "strategy": "keep"} for c in leaky[0]["columns"]]
    outcome = run(dataset, config(leaky))
    assert not outcome.succeeded and [(h.table, h.column, h.pattern, h.count) for h in outcome.verify.hits] == [("dbo.Person", "Notes", "phone-dashed", 1)]
    assert not stamp.read(dataset.folder).sanitized
    assert dataset.table("dbo.Person").where("FirstName = 'Ada'").count() == 1
    assert outcome.steps[-1].startswith("keep history again")


def test_a_broken_publish_puts_everything_back(spark, dataset, monkeypatch):
    move = Folder.move
    moved = []

    def breaks(self, name, to, as_name):
        moved.append(as_name)
        if to.root == dataset.folder.root and len(moved) == 4:
            raise OSError("the store is away")
        move(self, name, to, as_name)

    monkeypatch.setattr(Folder, "move", breaks)
    outcome = run(dataset, config())
    assert not outcome.succeeded and "store is away" in outcome.error and not stamp.read(dataset.folder).sanitized
    assert dataset.table("dbo.LoginAudit").count() == 1 and dataset.table("dbo.Person").where("FirstName = 'Ada'").count() == 1
    assert dataset.table("app.Membership").where("Email like '%example%'").count() == 3


def everything(dataset):
    """All text under the folder that still names a person."""
    import pathlib

    found = []
    for path in pathlib.Path(dataset.folder.root).parent.rglob("*.parquet"):
        if path.is_file():
            found += [str(path) for r in dataset.spark.read.parquet(str(path)).collect() if "Lovelace" in str(r) or "ada@" in str(r)]
    return found


def feeds(spark, dataset):
    old = spark.createDataFrame([(1, "Ada Lovelace")], "id int, was string")
    old.write.parquet(f"{dataset.folder.root}/_change_feed")
    old.write.parquet(f"{dataset.folder.root}/dbo.ContactImport.parquet/_change_data")
    spark.createDataFrame([("y",)], "v string").write.parquet(f"{dataset.folder.root}/dbo.Other.parquet")
    old.write.parquet(f"{dataset.folder.root}/dbo.Other.parquet/_change_data")
    return Dataset(spark, dataset.folder.root)


def test_change_feeds_go_before_the_stamp(spark, dataset):
    dataset = feeds(spark, dataset)
    assert len(dataset.feeds()) == 3 and everything(dataset)
    outcome = run(dataset, config())
    assert outcome.succeeded, outcome.error
    assert Dataset(spark, dataset.folder.root).feeds() == [] and everything(dataset) == []
    assert not dataset.catalog().change_feed and dataset.catalog().table("dbo.Person").primary_key == ("PersonId",)


@pytest.mark.parametrize("at", [1, 4, 8, 12, 15])
def test_a_store_that_fails_at_any_move_loses_nothing(spark, dataset, monkeypatch, at):
    dataset = feeds(spark, dataset)
    before = {n: rows(dataset.table(n)) for n in dataset.files}
    move, moved = Folder.move, []

    def breaks(self, name, to, as_name):
        moved.append(as_name)
        if len(moved) == at:
            raise OSError("the store is away")
        move(self, name, to, as_name)

    monkeypatch.setattr(Folder, "move", breaks)
    outcome = run(dataset, config())
    if len(moved) >= at:
        assert not outcome.succeeded and "store is away" in outcome.error and not stamp.read(dataset.folder).sanitized
        assert {n: rows(dataset.table(n)) for n in dataset.files} == before and len(dataset.feeds()) == 3


@pytest.mark.parametrize("at", [2, 5, 9])
def test_what_cannot_be_put_back_stays_in_staging(spark, dataset, monkeypatch, at):
    move, moved = Folder.move, []

    def breaks(self, name, to, as_name):
        moved.append(as_name)
        if len(moved) >= at:
            raise OSError("the store is away")
        move(self, name, to, as_name)

    monkeypatch.setattr(Folder, "move", breaks)
    outcome = run(dataset, config())
    assert not outcome.succeeded and "NotPutBack" in outcome.error and not stamp.read(dataset.folder).sanitized
    staging = Folder(spark, outcome.error.split("the old version is in ")[1].split(" ")[0])
    whole = sum(dataset.folder.exists(f) or staging.exists(f"_old-{f}") for f in dataset.files.values())
    assert whole == len(dataset.files) and any(n.startswith("_old-") for n in staging.names())


def test_a_history_that_is_gone_leaves_no_stamp(spark, dataset, monkeypatch):
    publish = runner.publish

    def loses(dataset, staging, files, step):
        publish(dataset, staging, files, step)
        dataset.folder.delete("dbo.PersonHistory.parquet")

    monkeypatch.setattr(runner, "publish", loses)
    outcome = run(dataset, config())
    assert "history of dbo.Person is gone" in outcome.error and not stamp.read(dataset.folder).sanitized


def test_batch_size_bounds_the_rows_of_a_file(spark, dataset):
    assert run(dataset, config(batchSize=1)).succeeded
    files = [n for n in Folder(spark, f"{dataset.folder.root}/app.Membership.parquet").names() if n.endswith(".parquet")]
    assert len(files) == 3


def test_commands(spark, dataset, tmp_path):
    path = tmp_path / "rules.json"

    def command(*argv, typed=None):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main([argv[0], "--dataset", dataset.folder.root, "--config", str(path), *argv[1:]], spark, out, err, lambda: typed)
        return code, out.getvalue() + err.getvalue()

    leaky = [dict(RULES[0], columns=[c if c["name"] != "Notes" else {"name": "Notes", "strategy": "keep"} for c in RULES[0]["columns"]]), *RULES[1:]]
    path.write_text(config(leaky))
    code, text = command("clean", typed="db")
    assert code == cli.VERIFY_FAILED and "1 x phone number (###-###-####) in dbo.Person.Notes" in text and "0100" not in text
    path.write_text("{")
    assert command("report")[0] == cli.BAD_CONFIG
    path.write_text(config(allowedServers=["elsewhere"]))
    assert command("clean")[0] == cli.REFUSED
    path.write_text(config(RULES[:2]))
    assert command("report")[0] == cli.UNCLASSIFIED
    path.write_text(config(RULES + [{"name": "dbo.Gone", "strategy": "truncate"}]))
    assert command("report")[0] == cli.BAD_CONFIG
    path.write_text(config())
    assert command("status")[0] == cli.VERIFY_FAILED
    assert command("clean", "--dry-run")[0] == cli.OK and not stamp.read(dataset.folder).sanitized
    assert command("clean", typed="DB")[0] == cli.REFUSED
    path.write_text(config(allowedServers=["prod"]))
    assert command("clean", "--yes", "--server", "prod")[0] == cli.REFUSED
    path.write_text(config())
    code, text = command("clean", typed="db")
    assert code == cli.OK and "ada@" not in text and "Lovelace" not in text
    assert command("status")[0] == cli.OK and "already" in command("clean")[1]


@pytest.mark.parametrize(("value", "yes"), [("true", True), ("True", True), ("TRUE", True), ("1", True), (" true ", True), ("false", False), ("0", False), ("", False), ("yes", False), ("tru", False), ("maybe", False), (None, False)])
def test_stamps(value, yes):
    assert stamp.interpret({"Sanitized": value}).sanitized is yes
    odd = stamp.interpret({"Sanitized": value, "SanitizedUtc": "someday"})
    assert odd.sanitized is yes and odd.when is None
    assert stamp.interpret({"SanitizedUtc": "2026-08-01T10:00:00"}).when == dt.datetime(2026, 8, 1, 10, tzinfo=dt.UTC)


def test_sweep_counts(spark):
    df = spark.createDataFrame([("a@b.co 123-45-6789", ("x@example.invalid",), 1), ("xxx@xxx.xx", (None,), 2), (None, None, 3)], "t string, s struct<u: string>, n int")
    found = {(r["column"], r["pattern"]): r["hits"] for r in sweep.counts(df).collect()}
    assert found[("t", "email")] == 1 and found[("t", "ssn")] == 1 and found[("s.u", "email")] == 1 and len(found) == 10
    assert {r["inspected"] for r in sweep.counts(df).where("column = 't'").collect()} == {2}
    total = sweep.totals(sweep.sweep({"a": df, "b": df.limit(0)})).first()
    assert (total["columns_scanned"], total["total_hits"], total["passed"]) == (4, 3, False)
    assert sweep.counts(spark.range(3)).count() == 0


def test_padded_columns_are_excused(spark):
    df = spark.sql("SELECT 'dev@example.invalid' AS v").select(F.rpad("v", 30, " ").alias("v", metadata={"__CHAR_VARCHAR_TYPE_STRING": "char(30)"}))
    assert sweep.counts(df, ["dev@example.invalid"]).agg(F.sum("hits")).first()[0] == 0


def test_keys(spark):
    df = spark.createDataFrame([(1, 100), (1, 101), (2, 100), (2, 101), (2, 102)], "a int, b int")
    assert rows(df.where(keyset.after(["a", "b"], [1, 101]))) == [(2, 100), (2, 101), (2, 102)]
    assert rows(keyset.page(df, ["a", "b"], 2, [1, 100])) == [(1, 101), (2, 100)]
    assert rows(df.where(keyset.between(["a", "b"], [1, 100], [2, 100]))) == [(1, 101), (2, 100)]
    r = keyset.reconcile(df, df.where("b <> 102").union(df.limit(1)), ["a", "b"]).first()
    assert (r["rows_before"], r["rows_after"], r["missing"], r["added"], r["complete"]) == (5, 5, 1, 1, False)
    assert keyset.key_quality(df, ["a", "b"]).first()["is_key"] and not keyset.key_quality(df, ["a"]).first()["is_key"]


def test_streams(spark, tmp_path):
    from sparkmask.plans.shortcut import table_plan

    df = spark.createDataFrame([(i, f"p{i}@example.invalid", dt.datetime(2026, 1, 1, i)) for i in range(6)], "id int, mail string, ts timestamp_ntz")
    df.write.parquet(f"{tmp_path}/in")
    plan = table_plan(df, "a.t", ["id"], {"mail": {"strategy": "email"}})
    given = stream.read_folder(spark, f"{tmp_path}/in", df.schema)
    kept = []

    def drain(frame, sink):
        frame.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{len(kept)}").start().awaitTermination()

    drain(stream.mask_stream(given, plan), stream.gate(lambda b, _: kept.extend(rows(b.select("id", "mail")))))
    assert kept == [(i, f"fakeemail{i}@notreal.invalid") for i in range(6)]
    with pytest.raises(Exception, match="GateFailed"):
        drain(given, stream.gate(lambda b, _: None))
    rates = stream.hit_rate(df, "ts", "mail", "1 day").where("pattern = 'email'").collect()
    assert [(r["hits"], r["rows"]) for r in rates] == [(6, 6)]
