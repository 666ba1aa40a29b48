"""One verdict for every column of the catalog, and problems for rules that fit nothing or can't be carried out."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from .meta import TOOL_TABLE, Catalog, ColumnMeta, TableMeta
from .rules import ColumnRule, HistoryMode, RuleSet, Strategy, TableRule, TableStrategy


class Action(Enum):
    UNTOUCHED = "untouched"
    TRUNCATE = "truncate"
    KEEP = "keep"
    MASK = "mask"
    HISTORY = "history of another table"
    TOOL = "written by the tool"


class Kind(Enum):
    UNCLASSIFIED = "unclassified"
    MASKED = "masked"
    KEPT = "kept"
    TRUNCATED = "truncated"
    COVERED = "covered by parent"
    EXEMPT = "exempt"


@dataclass(frozen=True)
class Verdict:
    column: ColumnMeta
    kind: Kind
    rule: ColumnRule | None = None
    reason: str | None = None


@dataclass(frozen=True)
class PlanProblem:
    path: str
    message: str
    fix: str = ""

    def __str__(self) -> str:
        return f"{self.path}: {self.message}" + (f" {self.fix}" if self.fix else "")


@dataclass(frozen=True)
class TableVerdicts:
    table: TableMeta
    action: Action
    verdicts: tuple[Verdict, ...]
    rule: TableRule | None = None
    history: HistoryMode = HistoryMode.TRUNCATE

    @property
    def unclassified(self) -> tuple[Verdict, ...]:
        return tuple(v for v in self.verdicts if v.kind is Kind.UNCLASSIFIED)


@dataclass(frozen=True)
class ScrubPlan:
    catalog: Catalog
    tables: tuple[TableVerdicts, ...]
    problems: tuple[PlanProblem, ...] = ()

    def count(self, kind: Kind) -> int:
        return sum(v.kind is kind for t in self.tables for v in t.verdicts)

    def of(self, action: Action) -> tuple[TableVerdicts, ...]:
        return tuple(t for t in self.tables if t.action is action)

    @property
    def unclassified(self) -> tuple[TableVerdicts, ...]:
        return tuple(t for t in self.tables if t.unclassified)


def resolve(catalog: Catalog, rules: RuleSet, exempt_computed: bool = False) -> ScrubPlan:
    """Verdicts of all tables.

    Names match in any case.  With exempt_computed a computed column without a rule is exempt; by default it is
    unclassified like any other, so that someone has looked at what it is made of.
    """
    left = {t.name.lower(): (i, t) for i, t in enumerate(rules.tables)}
    problems: list[PlanProblem] = []
    tables = []
    for t in catalog.tables:
        _, rule = left.pop(t.name.lower(), (0, None))
        tables.append(_table(catalog, t, rule, problems, exempt_computed))
    for i, rule in left.values():
        problems.append(PlanProblem(f"tables[{i}].name", f"There is no table {rule.name}."))
    return ScrubPlan(catalog, tuple(tables), tuple(problems))


def _table(catalog: Catalog, t: TableMeta, rule: TableRule | None, problems: list[PlanProblem], exempt_computed: bool) -> TableVerdicts:
    every = lambda kind, reason=None: tuple(Verdict(c, kind, reason=reason) for c in t.columns)
    if t.name.lower() == TOOL_TABLE.lower():
        return TableVerdicts(t, Action.TOOL, every(Kind.EXEMPT))
    if t.name.lower() in catalog.history_names:
        if rule is not None:
            problems.append(PlanProblem(t.name, "The table keeps another's history, so its own rule would never run.", 'Set "history" on the table it belongs to.'))
        return TableVerdicts(t, Action.HISTORY, every(Kind.COVERED))
    if rule is None:
        return TableVerdicts(t, Action.UNTOUCHED, tuple(_unruled(c, exempt_computed) for c in t.columns))
    if rule.strategy is TableStrategy.TRUNCATE:
        return TableVerdicts(t, Action.TRUNCATE, every(Kind.TRUNCATED), rule, rule.history)
    if rule.strategy is TableStrategy.KEEP:
        return TableVerdicts(t, Action.KEEP, every(Kind.KEPT, rule.reason), rule, rule.history)
    left = {c.name.lower(): c for c in rule.columns}
    verdicts = []
    for c in t.columns:
        own = left.pop(c.name.lower(), None)
        if own is None:
            verdicts.append(_unruled(c, exempt_computed))
            continue
        problems += [PlanProblem(f"{t.name}.{c.name}", *p) for p in _refusals(t, c, own)]
        verdicts.append(Verdict(c, Kind.KEPT if own.strategy is Strategy.KEEP else Kind.MASKED, own, own.reason))
    for own in left.values():
        problems.append(PlanProblem(f"{t.name}.{own.name}", f"{t.name} has no column {own.name}."))
    masked = any(v.kind is Kind.MASKED for v in verdicts)
    return TableVerdicts(t, Action.MASK if masked else Action.KEEP, tuple(verdicts), rule, rule.history)


def _unruled(c: ColumnMeta, exempt_computed: bool) -> Verdict:
    return Verdict(c, Kind.EXEMPT if c.generated or exempt_computed and c.computed is not None else Kind.UNCLASSIFIED)


def _refusals(t: TableMeta, c: ColumnMeta, rule: ColumnRule) -> list[tuple[str, str]]:
    """Why a rule can't be carried out on this column, in order; a key column has one reason alone."""
    if rule.strategy is Strategy.KEEP:
        return []
    if t.in_key(c.name):
        return [(f"{c.name} is part of the primary key, which rows are addressed by.", 'Use "keep".')]
    out = []
    if rule.strategy is Strategy.NULL and not c.nullable:
        out.append((f"{c.name} doesn't allow nulls.", 'Use "static" or "scramble".'))
    if c.computed is not None:
        out.append((f"{c.name} is computed from other columns and follows when they are masked.", 'Use "keep".'))
    elif c.identity:
        out.append((f"{c.name} is numbered by the system and can't be written.", 'Use "keep".'))
    elif c.generated:
        out.append((f"{c.name} is a period column that the system writes.", 'Use "keep".'))
    if not out and not rule.unique and rule.strategy is not Strategy.EMAIL:
        broken = [u for u in t.unique_rules if u.covers(c.name)]
        if broken:
            names = ", ".join(u.name for u in broken)
            out.append((f'"{rule.strategy.value}" would give rows the same {c.name}, which {names} must keep unique.', 'Use "email", or "scramble" with "unique": "key".'))
    return out
