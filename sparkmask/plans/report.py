"""The plan as text: what would happen, what is missing, and rules to paste."""

from __future__ import annotations

import json
import textwrap
from collections import Counter
from collections.abc import Callable

from sparkmask.functions.names import describe

from .run_plan import RunPlan
from .verdicts import Action, Kind, TableVerdicts

# From how many unclassified columns on a summary is shown, and how many tables and columns it names.
SUMMARY_ABOVE, TABLES_NAMED, COLUMNS_NAMED = 50, 12, 6
WIDTH = 78


def plural(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def wrapped(text: str, indent: str) -> list[str]:
    return textwrap.wrap(text, WIDTH, initial_indent=indent, subsequent_indent=indent + "  ")


def render(plan: RunPlan, review_all: bool = False) -> str:
    scrub = plan.scrub
    lines = [f"Plan for {scrub.catalog.name}", "", f"{plural(len(scrub.catalog.tables), 'table')}, {plural(sum(len(t.columns) for t in scrub.catalog.tables), 'column')}", ""]
    lines += ["Before masking"] + [f"  {s}" for s in plan.before] + ["", "Masking"]
    for t in plan.mask.tables:
        lines.append(f"  {t.table.name} ({t.mode.value})")
        lines += [f"    {c.column.name}: {c.strategy.value}" + (" with key" if c.unique else "") for c in t.columns]
    lines += [] if plan.mask.tables else ["  nothing"]
    lines += ["", "After masking"] + ([f"  {s}" for s in plan.after] or ["  nothing"])
    lines += ["", "Summary", f"  {plural(scrub.count(Kind.MASKED), 'column')} masked, {scrub.count(Kind.KEPT)} kept, {scrub.count(Kind.UNCLASSIFIED)} unclassified"]
    lines.append(f"  {plural(len(scrub.of(Action.TRUNCATE)), 'table')} emptied, {len(scrub.of(Action.MASK))} masked")
    if plan.problems:
        lines += ["", plural(len(plan.problems), "problem")]
        for p in plan.problems:
            lines += wrapped(str(p), "  ")
    if scrub.unclassified:
        n = scrub.count(Kind.UNCLASSIFIED)
        lines += ["", f"{plural(n, 'column')} unclassified"]
        lines += [unclassified(scrub.unclassified)] if review_all or n <= SUMMARY_ABOVE else summary(scrub.unclassified)
    return "\n".join(lines) + "\n"


def entry(t: TableVerdicts) -> str:
    """Rules to paste: a whole table entry, or the column entries that an existing one lacks."""
    columns = [json.dumps({"name": v.column.name, "strategy": "keep", "reason": "TODO"}, ensure_ascii=False) for v in t.unclassified]
    if t.rule is not None:
        return ",\n".join(columns)
    return "{ " + f'"name": {json.dumps(t.table.name, ensure_ascii=False)}, "columns": [\n  ' + ",\n  ".join(columns) + "\n] }"


def unclassified(tables: tuple[TableVerdicts, ...]) -> str:
    out = []
    for t in tables:
        where = "add to its columns" if t.rule is not None else "add to tables"
        out.append(f"  {t.table.name}: {plural(len(t.unclassified), 'column')}; {where}:\n" + textwrap.indent(entry(t), "    "))
    return "\n".join(out)


def summary(tables: tuple[TableVerdicts, ...], hint: Callable[[str], tuple[str, str] | None] = describe) -> list[str]:
    """Tables with the most strong hints first, then by name; kinds of hints by number, then by name."""
    kinds: Counter[str] = Counter()
    flagged = []
    for t in tables:
        found = [(v.column.name, h) for v in t.unclassified if (h := hint(v.column.name))]
        kinds.update(kind for _, (_, kind) in found)
        if found:
            flagged.append((-sum(s == "strong" for _, (s, _) in found), t.table.name, [c for c, _ in found]))
    lines = [f"  {n} x {kind}" for kind, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0]))]
    flagged.sort()
    width = max((len(name) for _, name, _ in flagged[:TABLES_NAMED]), default=0)
    for _, name, columns in flagged[:TABLES_NAMED]:
        more = f" +{len(columns) - COLUMNS_NAMED} more" if len(columns) > COLUMNS_NAMED else ""
        lines.append(f"  {name:<{width}}  {', '.join(columns[:COLUMNS_NAMED])}{more}")
    if len(flagged) > TABLES_NAMED:
        lines.append(f"  and {plural(len(flagged) - TABLES_NAMED, 'table')} more with names that sound personal")
    quiet = len(tables) - len(flagged)
    if quiet:
        lines.append(f"  {plural(quiet, 'table')} without such names")
    return [*lines, "  Use --review-all for rules to paste."]
