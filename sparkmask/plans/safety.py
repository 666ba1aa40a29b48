"""What may be masked, and the confirmation that a person types."""

from __future__ import annotations

from collections.abc import Iterable

from .run_plan import RunPlan, StepKind
from .verdicts import Action, Kind

# Hosts on which a run may go without a typed confirmation.
UNATTENDED = ("localhost", ".", "127.0.0.1")


def allowed(server: str | None, servers: Iterable[str]) -> bool:
    """Exact match but for space around and case; never a beginning of a name."""
    name = (server or "").strip().lower()
    return bool(name) and name in {s.strip().lower() for s in servers}


def unattended(server: str | None) -> bool:
    """Whether the part before a backslash is surely this machine."""
    return (server or "").strip().split("\\")[0].lower() in UNATTENDED


def confirmed(typed: str | None, name: str | None) -> bool:
    """Equal but for space around; case counts, and neither may be blank."""
    a, b = (typed or "").strip(), (name or "").strip()
    return bool(a) and a == b


def summary(plan: RunPlan, server: str) -> str:
    scrub = plan.scrub
    lines = [
        "This run will CHANGE the dataset, and there is no way back.",
        "",
        f"  where           {server}",
        f"  dataset         {scrub.catalog.name}",
        f"  tables emptied  {len(scrub.of(Action.TRUNCATE))}",
        f"  tables masked   {len(scrub.of(Action.MASK))}",
        f"  columns masked  {scrub.count(Kind.MASKED)}",
    ]
    if any(s.kind is StepKind.DROP_CHANGE_FEED for s in plan.before):
        lines += ["", "  The change feed is dropped, with the copies of old rows that it holds."]
    histories = [t.table.name for t in scrub.tables if t.table.history]
    if histories:
        lines += ["", f"  Histories of {', '.join(histories)} are emptied or masked."]
    return "\n".join(lines) + "\n"


def prompt(name: str) -> str:
    return f"Type the name of the dataset ({name}) to go on: "


def refusal(name: str) -> str:
    return f"That isn't {name}, so nothing was changed."
