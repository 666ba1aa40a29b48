"""A run: mask into a staging folder, reconcile, sweep, publish, stamp.

Files can't be updated in place, so nothing of the source changes until every gate has passed.  A failed gate leaves the
source as it was and no stamp; so does a table that can't be published, as tables published before it are put back.
What can't be put back stays in the staging folder, which the error names.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmask.operators import keyset, stamp, sweep
from sparkmask.operators.mask import emptied, masked
from sparkmask.plans.masker import TableMask
from sparkmask.plans.meta import TOOL_TABLE, TableMeta
from sparkmask.plans.run_plan import RunPlan, StepKind
from sparkmask.sources.dataset import FACTS, Dataset, Folder


@dataclass(frozen=True)
class MaskResult:
    table: str
    rows_before: int
    rows_after: int
    missing: int = 0
    added: int = 0

    @property
    def complete(self) -> bool:
        return self.rows_before == self.rows_after and not self.missing and not self.added


@dataclass(frozen=True)
class Hit:
    table: str
    column: str
    pattern: str
    count: int


@dataclass(frozen=True)
class VerifyReport:
    hits: tuple[Hit, ...]
    columns_scanned: int
    rows_inspected: int

    @property
    def passed(self) -> bool:
        return not self.hits

    @property
    def total(self) -> int:
        return sum(h.count for h in self.hits)


@dataclass
class Outcome:
    results: list[MaskResult] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    verify: VerifyReport | None = None
    stamped: bool = False
    error: str | None = None

    @property
    def incomplete(self) -> list[str]:
        return [r.table for r in self.results if not r.complete]

    @property
    def succeeded(self) -> bool:
        return self.error is None and not self.incomplete and self.verify is not None and self.verify.passed and self.stamped


def verify(tables: dict[str, DataFrame], known=(), compatible: bool = False) -> VerifyReport:
    """The sweep's result; only counts come to the driver, never a value."""
    tables = {n: df for n, df in tables.items() if n.lower() != TOOL_TABLE.lower()}
    if not tables:
        return VerifyReport((), 0, 0)
    rows = sweep.sweep(tables, known, compatible).toArrow().to_pylist()
    hits = tuple(Hit(r["table"], r["column"], r["pattern"], r["hits"]) for r in sorted(rows, key=lambda r: (r["table"], r["column"], r["pattern"])) if r["hits"])
    looked = {(r["table"], r["column"]): r["inspected"] for r in rows}
    return VerifyReport(hits, len(looked), sum(looked.values()))


def staged_tables(dataset: Dataset, plan: RunPlan) -> dict[str, DataFrame]:
    """What every table becomes; tables without a mask or an emptying stay as they are."""
    masks: dict[str, TableMask] = {m.table.name.lower(): m for m in plan.mask.tables}
    parents = {t.table.history.lower(): t.table for t in plan.scrub.tables if t.table.history}
    empty = {s.table.lower() for s in plan.before if s.kind in (StepKind.EMPTY_HISTORY, StepKind.EMPTY_TABLE) and s.table}
    out = {}
    for name in dataset.files:
        df = dataset.table(name)
        if name.lower() in empty:
            df = emptied(df)
        elif name.lower() in masks:
            df = masked(df, masks[name.lower()], parents.get(name.lower()))
        out[name] = df
    return out


class NotPutBack(RuntimeError):
    """Something could be neither published nor put back; the staging folder is kept, as it holds the only copy."""


def run(dataset: Dataset, plan: RunPlan, config_hash: str, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC), tell: Callable[[str], None] = lambda _: None) -> Outcome:
    """Carries out a plan; steps after masking happen whatever went wrong before, and stop at their first failure.

    The stamp comes last: after the old rows and change feeds are gone, and after histories are kept again.
    """
    if plan.problems:
        raise ValueError("a plan with problems isn't run")
    began, outcome = time.monotonic(), Outcome()
    staging = Folder(dataset.spark, f"{dataset.folder.root}.staging-{uuid.uuid4().hex}")

    def step(text: str) -> None:
        outcome.steps.append(text)
        tell(text)

    kept = False
    try:
        for s in plan.before:
            step(str(s))
        staging.make()
        changed = {m.table.name.lower() for m in plan.mask.tables} | {s.table.lower() for s in plan.before if s.kind in (StepKind.EMPTY_HISTORY, StepKind.EMPTY_TABLE)}
        changed |= {n.lower() for n in dataset.jdbc}
        tables = staged_tables(dataset, plan)
        written = [dataset.files[n] for n in tables if n.lower() in changed]
        for name in [n for n in tables if n.lower() in changed]:
            step(f"mask: {name}")
            given = tables[name].write.mode("overwrite").option("maxRecordsPerFile", plan.rows_per_file or 0)
            given.parquet(f"{staging.root}/{dataset.files[name]}")
            tables[name] = dataset.spark.read.parquet(f"{staging.root}/{dataset.files[name]}")
        for m in plan.mask.tables:
            outcome.results.append(_reconciled(m, dataset.table(m.table.name), tables))
        if outcome.incomplete:
            raise RuntimeError(f"rows are missing or were added in {', '.join(outcome.incomplete)}")
        step("verify")
        outcome.verify = verify(tables, plan.mask.replacements)
        if outcome.verify.passed:
            if any(s.kind is StepKind.DROP_CHANGE_FEED for s in plan.before):
                written += [f for f in dataset.feeds() if f.split("/")[0] not in written]
                staging.write_text(FACTS, _without_feeds(dataset.folder.read_text(FACTS)))
                written.append(FACTS)
            publish(dataset, staging, written, step)
            step("delete old rows")
            staging.delete()
    except Exception as e:  # a run that broke off has failed, whatever it had done
        outcome.error, kept = f"{type(e).__name__}: {e}", isinstance(e, NotPutBack)
    try:
        for s in plan.after:
            step(str(s))
            _keep_history(dataset, plan.scrub.catalog.table(s.table))
        if not kept:
            staging.delete()
    except Exception as e:
        outcome.error = "; ".join(filter(None, [outcome.error, f"{type(e).__name__}: {e}"]))
    if outcome.error is None and outcome.verify is not None and outcome.verify.passed:
        try:
            step("stamp")
            emptied_tables = {s.table.lower() for s in plan.before if s.kind is StepKind.EMPTY_TABLE}
            rows = sum(r.rows_after for r in outcome.results)
            stamp.write(dataset.folder, stamp.Record(clock(), config_hash, len(emptied_tables) + len(plan.mask.tables), rows, time.monotonic() - began))
            outcome.stamped = True
        except Exception as e:
            outcome.error = f"{type(e).__name__}: {e}"
    return outcome


def _without_feeds(facts: str | None) -> str:
    """The facts of a dataset whose change feeds are gone."""
    given = json.loads(facts or "{}")
    given["changeFeed"] = False
    for t in given.get("tables", {}).values():
        if "changeFeed" in t:
            t["changeFeed"] = False
    return json.dumps(given, indent=1)


def _keep_history(dataset: Dataset, table: TableMeta | None) -> None:
    """A versioned table's history must be where it was, masked or emptied."""
    file = next((f for n, f in dataset.files.items() if table and table.history and n.lower() == table.history.lower()), None)
    if file and not dataset.folder.exists(file):
        raise RuntimeError(f"the history of {table.name} is gone")


def publish(dataset: Dataset, staging: Folder, files: list[str], step: Callable[[str], None]) -> None:
    """Swaps files for their new versions, or moves out those that have none; if one can't be, all are put back.

    NotPutBack names what can't be put back; the staging folder holds it then as _old-NAME and must stay.
    """
    old = lambda file: "_old-" + file.replace("/", "__")
    done = []
    try:
        for file in files:
            step(f"publish: {file}")
            had = dataset.folder.exists(file)
            done.append((file, had))
            if had:
                dataset.folder.move(file, staging, old(file))
            if staging.exists(file):
                staging.move(file, dataset.folder, file)
    except Exception as e:
        stuck = []
        for file, had in reversed(done):
            try:
                if staging.exists(old(file)):
                    if dataset.folder.exists(file):
                        dataset.folder.move(file, staging, "_new-" + file.replace("/", "__"))
                    staging.move(old(file), dataset.folder, file)
                elif not had and dataset.folder.exists(file):
                    dataset.folder.move(file, staging, file)
            except Exception:  # the others are put back all the same
                stuck.append(file)
        if stuck:
            raise NotPutBack(f"{', '.join(stuck)} could not be put back; the old version is in {staging.root} ({e})") from e
        raise


def _reconciled(mask: TableMask, before: DataFrame, tables: dict[str, DataFrame]) -> MaskResult:
    name = next(n for n in tables if n.lower() == mask.table.name.lower())
    keys = [k.name for k in mask.table.key_columns]
    if keys:
        r = keyset.reconcile(before, tables[name], keys).first()
        return MaskResult(name, r["rows_before"], r["rows_after"], r["missing"], r["added"])
    counts = [df.agg(F.count("*")).first()[0] for df in (before, tables[name])]
    return MaskResult(name, *counts)
