"""report, clean and status for a dataset folder.

    python -m sparkmask.cli report --dataset DIR --config FILE [--review-all]
    python -m sparkmask.cli clean  --dataset DIR --config FILE [--yes] [--dry-run] [--fail-on-unclassified] [--review-all]
    python -m sparkmask.cli status --dataset DIR [--config FILE]

--server names the machine or store that the folder belongs to; it is localhost for a plain path.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from typing import TextIO

from sparkmask.functions.patterns import LABELS
from sparkmask.operators import runner, stamp
from sparkmask.plans import report, run_plan, safety
from sparkmask.plans.rules import ALLOWED_SERVERS, InvalidRules, RuleSet, load_file
from sparkmask.plans.verdicts import Kind
from sparkmask.sources.dataset import Dataset

# Exit codes.
OK, UNEXPECTED, VERIFY_FAILED, UNCLASSIFIED, REFUSED, BAD_CONFIG = range(6)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkmask", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("report", "clean", "status"):
        p = sub.add_parser(name)
        p.add_argument("--dataset", required=True)
        p.add_argument("--server", default="localhost")
        p.add_argument("--config", required=name != "status")
        if name != "status":
            p.add_argument("--review-all", action="store_true")
        if name == "clean":
            p.add_argument("--yes", action="store_true")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--fail-on-unclassified", action="store_true")
    return top


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sparkmask").getOrCreate()


def main(argv: Sequence[str] | None = None, spark=None, out: TextIO | None = None, err: TextIO | None = None, ask: Callable[[], str | None] = input) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        return _main(parser().parse_args(argv), spark, out, err, ask)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=err)
        return UNEXPECTED


def _main(args: argparse.Namespace, spark, out: TextIO, err: TextIO, ask: Callable[[], str | None]) -> int:
    rules = RuleSet()
    if args.config:
        try:
            rules = load_file(args.config)
        except InvalidRules as e:
            for p in e.problems:
                print(f"{args.config}{p}", file=err)
            return BAD_CONFIG
    if not safety.allowed(args.server, rules.allowed_servers if args.config else ALLOWED_SERVERS):
        print(f"{args.server} isn't one of the allowed servers.", file=err)
        return REFUSED
    dataset = Dataset(spark or session(), args.dataset)
    if args.command == "status":
        return status(dataset, out)
    if args.command == "clean" and (found := stamp.read(dataset.folder)).sanitized:
        print(f"{dataset.name} is masked already{f' since {found.when:%Y-%m-%d %H:%M} UTC' if found.when else ''}.", file=out)
        return OK
    fail = True if getattr(args, "fail_on_unclassified", False) else None
    plan = run_plan.build(dataset.catalog(), rules, fail=fail)
    out.write(report.render(plan, args.review_all))
    if plan.problems:
        return BAD_CONFIG
    if plan.blocked:
        print(f"{report.plural(plan.scrub.count(Kind.UNCLASSIFIED), 'column')} unclassified, so nothing is run.", file=err)
        return UNCLASSIFIED
    if args.command == "report" or args.dry_run:
        return OK
    out.write(safety.summary(plan, args.server))
    if args.yes:
        if not safety.unattended(args.server):
            print(f"--yes isn't taken for {args.server}; type the name instead.", file=err)
            return REFUSED
    else:
        out.write(safety.prompt(dataset.name))
        if not safety.confirmed(ask(), dataset.name):
            print(safety.refusal(dataset.name), file=err)
            return REFUSED
    return told(runner.run(dataset, plan, rules.hash, tell=lambda s: print(f"  {s}", file=out)), out, err)


def status(dataset: Dataset, out: TextIO) -> int:
    found = stamp.read(dataset.folder)
    if not found.sanitized:
        print(f"{dataset.name} is not stamped as masked.", file=out)
        return VERIFY_FAILED
    when = f"{found.when:%Y-%m-%d %H:%M} UTC" if found.when else "at an unknown time"
    print(f"{dataset.name} was masked {when}, rules {found.config_hash or 'unknown'}, version {found.tool_version or 'unknown'}.", file=out)
    return OK


def told(outcome: runner.Outcome, out: TextIO, err: TextIO) -> int:
    """Counts and places alone; a value is never written."""
    for r in outcome.results:
        print(f"  {r.table}: {r.rows_before} rows, {r.rows_after} after" + ("" if r.complete else ", INCOMPLETE"), file=out)
    if outcome.verify is not None and not outcome.verify.passed:
        print(f"{report.plural(outcome.verify.total, 'value')} still look personal; nothing was published:", file=err)
        for h in sorted(outcome.verify.hits, key=lambda h: (-h.count, h.table, h.column, h.pattern)):
            label, shape = LABELS[h.pattern]
            print(f"  {h.count} x {label} ({shape}) in {h.table}.{h.column}", file=err)
        return VERIFY_FAILED
    if not outcome.succeeded:
        print(f"The run failed: {outcome.error or 'it was not completed'}", file=err)
        return UNEXPECTED
    print(f"Masked, verified ({outcome.verify.columns_scanned} columns) and stamped.", file=out)
    return OK


if __name__ == "__main__":
    sys.exit(main())
