"""The whole run: steps before masking, masks, steps after."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from . import masker
from .masker import MaskPlan
from .meta import Catalog, Temporal
from .rules import BATCH_SIZE, HistoryMode, RuleSet, Unclassified
from .verdicts import Action, Kind, PlanProblem, ScrubPlan, resolve


class StepKind(Enum):
    SIMPLE_RECOVERY = "note that nothing of the run is logged for recovery"
    DROP_CHANGE_FEED = "drop the change feed"
    DETACH_HISTORY = "stop keeping history"
    EMPTY_HISTORY = "empty the history"
    EMPTY_TABLE = "empty the table"
    REATTACH_HISTORY = "keep history again"


@dataclass(frozen=True)
class Step:
    kind: StepKind
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.kind.value}" + (f": {self.table}" if self.table else "")


@dataclass(frozen=True)
class RunPlan:
    scrub: ScrubPlan
    before: tuple[Step, ...]
    mask: MaskPlan
    after: tuple[Step, ...]
    fail_on_unclassified: bool = False
    rows_per_file: int | None = None  # None leaves the size of files to Spark

    @property
    def problems(self) -> tuple[PlanProblem, ...]:
        return self.scrub.problems + self.mask.problems

    @property
    def blocked(self) -> bool:
        """Whether unclassified columns stop the run."""
        return self.fail_on_unclassified and self.scrub.count(Kind.UNCLASSIFIED) > 0


def build(catalog: Catalog, rules: RuleSet, strict: bool = True, fail: bool | None = None) -> RunPlan:
    """Histories of all versioned tables are detached, and emptied unless their rule masks them, rule or not.

    A batch size other than the default bounds the rows of a written file, as files are what is written at once here.
    """
    scrub = resolve(catalog, rules)
    versioned = [t for t in scrub.tables if t.table.temporal is Temporal.VERSIONED]
    before = [Step(StepKind.SIMPLE_RECOVERY)]
    if catalog.change_feed or any(t.change_feed for t in catalog.tables):
        before.append(Step(StepKind.DROP_CHANGE_FEED))
    for t in versioned:
        before.append(Step(StepKind.DETACH_HISTORY, t.table.name))
        if t.table.history and t.history is not HistoryMode.MASK:
            before.append(Step(StepKind.EMPTY_HISTORY, t.table.history))
    before += [Step(StepKind.EMPTY_TABLE, t.table.name) for t in scrub.of(Action.TRUNCATE)]
    after = [Step(StepKind.REATTACH_HISTORY, t.table.name) for t in versioned]
    fail = rules.unclassified is Unclassified.FAIL if fail is None else fail
    rows_per_file = rules.batch_size if rules.batch_size != BATCH_SIZE else None
    return RunPlan(scrub, tuple(before), masker.build(scrub, strict), tuple(after), fail, rows_per_file)
