"""What masking writes to each table, and refusals before anything is written."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

from .keys import EMAIL_OVERHEAD, max_width, renderable, spliceable
from .meta import ColumnMeta, TableMeta
from .rules import ColumnRule, HistoryMode, Strategy
from .static_value import Refused, convert
from .verdicts import Action, Kind, PlanProblem, ScrubPlan, TableVerdicts


class Mode(Enum):
    ROW_BY_ROW = "row by row"
    BATCHED_CONSTANT = "batched constant"
    WHOLE_TABLE = "whole table"


@dataclass(frozen=True)
class MaskColumn:
    column: ColumnMeta
    strategy: Strategy
    value: object = None
    unique: bool = False

    @property
    def constant(self) -> bool:
        return self.strategy in (Strategy.NULL, Strategy.STATIC)

    @property
    def reads_value(self) -> bool:
        return self.strategy is Strategy.SCRAMBLE

    @property
    def reads_key(self) -> bool:
        return self.strategy is Strategy.EMAIL or self.unique


@dataclass(frozen=True)
class TableMask:
    table: TableMeta
    columns: tuple[MaskColumn, ...]
    mode: Mode

    @property
    def read_columns(self) -> tuple[str, ...]:
        """Columns whose old values matter: keys that values are made from, and what is scrambled."""
        key = [c.name for c in self.table.key_columns] if any(c.reads_key for c in self.columns) else []
        return tuple(dict.fromkeys([*key, *(c.column.name for c in self.columns if c.reads_value)]))


@dataclass(frozen=True)
class MaskPlan:
    tables: tuple[TableMask, ...]
    problems: tuple[PlanProblem, ...] = ()

    @property
    def replacements(self) -> frozenset[str]:
        """Texts that `static` writes; the sweep excuses exactly these."""
        return frozenset(c.value for t in self.tables for c in t.columns if c.strategy is Strategy.STATIC and isinstance(c.value, str) and c.value)


def build(plan: ScrubPlan, strict: bool = True) -> MaskPlan:
    """Masks of all tables with a masked column, and of histories that are masked rather than emptied.

    strict refuses values made per row where a table has no key, as stores that update in place must; a projection could
    scramble such a table, and strict=False lets it.
    """
    tables, problems = [], []
    for t in plan.of(Action.MASK):
        columns = [m for v in t.verdicts if v.kind is Kind.MASKED and v.column.writable and not t.table.in_key(v.column.name) and (m := _column(t.table, v.column, v.rule, problems))]
        if columns:
            tables.append(_table(t.table, columns, problems, strict))
        if t.history is HistoryMode.MASK and t.table.history:
            tables += _history(plan, t, columns, problems, strict)
    return MaskPlan(tuple(tables), tuple(problems))


def _history(plan: ScrubPlan, parent: TableVerdicts, columns: list[MaskColumn], problems: list[PlanProblem], strict: bool) -> Iterable[TableMask]:
    old = plan.catalog.table(parent.table.history)
    if old is None:
        problems.append(PlanProblem(parent.table.name, f"Its history {parent.table.history} can't be read.", 'Use "history": "truncate".'))
        return
    out = []
    for c in columns:
        own = old.column(c.column.name)
        if own is None:
            problems.append(PlanProblem(old.name, f"The history has no column {c.column.name}."))
        else:
            out.append(MaskColumn(own, c.strategy, c.value, c.unique))
    if out:
        yield _table(old, out, problems, strict, key=parent.table)


def _table(t: TableMeta, columns: list[MaskColumn], problems: list[PlanProblem], strict: bool, key: TableMeta | None = None) -> TableMask:
    per_row = [c.column.name for c in columns if not c.constant]
    if per_row and not t.primary_key and strict:
        problems.append(PlanProblem(t.name, f"The table has no primary key, so values of {', '.join(per_row)} can't be made row by row.", 'Use "static" or "null", which are alike for all rows, or "history": "truncate".'))
    mode = Mode.ROW_BY_ROW if per_row else Mode.BATCHED_CONSTANT if t.primary_key else Mode.WHOLE_TABLE
    return TableMask(t, tuple(columns), mode)


def _column(t: TableMeta, c: ColumnMeta, rule: ColumnRule, problems: list[PlanProblem]) -> MaskColumn | None:
    def refuse(message: str, fix: str) -> None:
        problems.append(PlanProblem(f"{t.name}.{c.name}", message, fix))

    if rule.strategy is Strategy.NULL:
        return MaskColumn(c, Strategy.NULL) if c.nullable else None  # the verdict has told why not
    if rule.strategy is Strategy.STATIC:
        try:
            if rule.value is None:
                raise Refused(f"{c.name} has no value.")
            return MaskColumn(c, Strategy.STATIC, convert(rule.value, c))
        except Refused as e:
            return refuse(str(e), "")
    what = "an address" if rule.strategy is Strategy.EMAIL else "a scrambled text"
    if not c.textual:
        return refuse(f"{c.name} is of type {c.data_type.simpleString()}, which can't hold {what}.", 'Use "static" or "null".')
    if rule.strategy is Strategy.SCRAMBLE and not rule.unique:
        return MaskColumn(c, Strategy.SCRAMBLE)
    if not t.primary_key:
        return refuse(f"{t.name} has no primary key to make {c.name} from.", 'Use "static" or "null".')
    usable = spliceable if rule.unique else renderable
    odd = [k.name for k in t.key_columns if not usable(k)]
    if odd or len(t.key_columns) != len(t.primary_key):
        return refuse(f"The key of {t.name} can't be written into {c.name}: {', '.join(odd) or 'it names missing columns'}.", "Keys of whole numbers can" + ("." if rule.unique else ", and UUIDs."))
    need = max_width(t.key_columns) + (1 if rule.unique else EMAIL_OVERHEAD)
    if c.max_length is not None and c.max_length < need:
        return refuse(f"{c.name} holds {c.max_length} characters and needs {need}.", "Widen the column or choose another strategy.")
    return MaskColumn(c, rule.strategy, unique=rule.unique)
