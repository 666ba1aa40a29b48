"""The rule file: its model, and a loader that reports every problem with its place."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from enum import Enum

from .jsontext import BadJson, Node, read


class Strategy(Enum):
    NULL = "null"
    STATIC = "static"
    SCRAMBLE = "scramble"
    KEEP = "keep"
    EMAIL = "email"


class TableStrategy(Enum):
    TRUNCATE = "truncate"
    KEEP = "keep"


class HistoryMode(Enum):
    TRUNCATE = "truncate"
    MASK = "mask"


class Unclassified(Enum):
    WARN = "warn"
    FAIL = "fail"


# Codes of problems.
INVALID_JSON, UNKNOWN_PROPERTY, MISSING_PROPERTY, INVALID_TYPE, INVALID_VALUE = "DBS001", "DBS002", "DBS003", "DBS004", "DBS005"
REQUIRES_VALUE, VALUE_NOT_ALLOWED, DUPLICATE, CONTRADICTORY = "DBS006", "DBS007", "DBS008", "DBS009"

# Defaults and bounds, and the properties of each object.
ALLOWED_SERVERS = ("localhost", ".", "(local)", "127.0.0.1")
BATCH_SIZE, LARGEST_BATCH = 5_000, 1_000_000
COMMENT = "$comment"
ROOT = (COMMENT, "defaults", "tables")
DEFAULTS = (COMMENT, "allowedServers", "unclassifiedColumns", "batchSize", "renameTo", "repairUsers")
TABLE = (COMMENT, "name", "strategy", "history", "columns", "reason")
COLUMN = (COMMENT, "name", "strategy", "value", "reason", "unique")
TYPO_DISTANCE = 2


@dataclass(frozen=True)
class Problem:
    code: str
    path: str
    message: str
    fix: str = ""
    line: int | None = None
    column: int | None = None

    def __str__(self) -> str:
        place = f"({self.line},{self.column})" if self.line else ""
        return f"{place}{self.code} {self.path}: {self.message}" + (f" {self.fix}" if self.fix else "")


@dataclass(frozen=True)
class StaticSpec:
    """A value as written: `5000` and `"5000"` differ."""

    kind: str  # string, number, boolean
    text: str


@dataclass(frozen=True)
class ColumnRule:
    name: str
    strategy: Strategy
    value: StaticSpec | None = None
    reason: str | None = None
    unique: bool = False


@dataclass(frozen=True)
class TableRule:
    schema: str
    table: str
    strategy: TableStrategy | None = None
    history: HistoryMode = HistoryMode.TRUNCATE
    columns: tuple[ColumnRule, ...] = ()
    reason: str | None = None

    @property
    def name(self) -> str:
        return f"{self.schema}.{self.table}"


@dataclass(frozen=True)
class RuleSet:
    tables: tuple[TableRule, ...] = ()
    allowed_servers: tuple[str, ...] = ALLOWED_SERVERS
    unclassified: Unclassified = Unclassified.WARN
    batch_size: int = BATCH_SIZE
    rename_to: str | None = None
    repair_users: tuple[str, ...] = ()
    hash: str = field(default="", compare=False)


class InvalidRules(ValueError):
    def __init__(self, problems: list[Problem]):
        super().__init__("\n".join(map(str, problems)))
        self.problems = problems


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(given: str, known: tuple[str, ...]) -> str | None:
    """The known name within TYPO_DISTANCE, in any case; the first of the nearest."""
    distance, _, name = min((levenshtein(given.lower(), k.lower()), i, k) for i, k in enumerate(known))
    return name if distance <= TYPO_DISTANCE else None


class _Loader:
    """Walks the document and collects problems; each reader gives None where it found one."""

    def __init__(self) -> None:
        self.problems: list[Problem] = []

    def add(self, code: str, path: str, node: Node | tuple, message: str, fix: str = "") -> None:
        line, column = (node.line, node.column) if isinstance(node, Node) else node
        self.problems.append(Problem(code, path, message, fix, line, column))

    def object(self, node: Node, path: str, what: str, known: tuple[str, ...]) -> dict[str, Node] | None:
        if node.kind != "object":
            self.add(INVALID_TYPE, path, node, f"{what} must be an object, not {node.kind}.")
            return None
        for name, *place in node.names:
            if name not in known:
                near = nearest(name, known)
                self.add(UNKNOWN_PROPERTY, f"{path}.{name}".lstrip("."), tuple(place), f'"{name}" is not a property of {what.lower()}.', f'Did you mean "{near}"?' if near else f"Known: {', '.join(known)}.")
        return node.value

    def text(self, node: Node, path: str, what: str) -> str | None:
        if node.kind != "string":
            self.add(INVALID_VALUE if node.kind == "null" else INVALID_TYPE, path, node, f"{what} must be a string, not {node.kind}.")
        elif not node.value.strip():
            self.add(INVALID_VALUE, path, node, f"{what} is empty.")
        else:
            return node.value
        return None

    def choice(self, node: Node, path: str, what: str, options: type[Enum]):
        value = self.text(node, path, what)
        names = [o.value for o in options]
        if value is not None and value not in names:
            near = nearest(value, tuple(names))
            self.add(INVALID_VALUE, path, node, f'{what} can\'t be "{value}".', (f'Did you mean "{near}"? ' if near else "") + f"It is one of {', '.join(names)}.")
            return None
        return options(value) if value is not None else None

    def texts(self, node: Node, path: str, what: str) -> tuple[str, ...] | None:
        if node.kind != "array":
            self.add(INVALID_TYPE, path, node, f"{what} must be an array, not {node.kind}.")
            return None
        return tuple(x for i, n in enumerate(node.value) if (x := self.text(n, f"{path}[{i}]", f"An entry of {what}")) is not None)

    def rules(self, root: Node) -> RuleSet:
        top = self.object(root, "", "The rule file", ROOT)
        if top is None:
            return RuleSet()
        given = self.defaults(top["defaults"]) if "defaults" in top else {}
        tables: list[TableRule] = []
        if "tables" not in top:
            self.add(MISSING_PROPERTY, "tables", root, '"tables" is missing.', "An empty array is a start.")
        elif top["tables"].kind != "array":
            self.add(INVALID_TYPE, "tables", top["tables"], f'"tables" must be an array, not {top["tables"].kind}.')
        else:
            seen: dict[str, int] = {}
            for i, node in enumerate(top["tables"].value):
                rule = self.table(node, f"tables[{i}]")
                if rule is None:
                    continue
                if rule.name.lower() in seen:
                    self.add(DUPLICATE, f"tables[{i}].name", node.value["name"], f"{rule.name} is already at tables[{seen[rule.name.lower()]}].", "Merge the two entries.")
                else:
                    seen[rule.name.lower()] = i
                    tables.append(rule)
        return RuleSet(tuple(tables), **given)

    def defaults(self, node: Node) -> dict:
        path, out = "defaults", {}
        given = self.object(node, path, '"defaults"', DEFAULTS) or {}
        if "allowedServers" in given:
            servers = self.texts(given["allowedServers"], f"{path}.allowedServers", '"allowedServers"')
            if servers == () and not given["allowedServers"].value:
                self.add(INVALID_VALUE, f"{path}.allowedServers", given["allowedServers"], "An empty list allows nothing to be masked.", "Leave it out for the local defaults.")
            out["allowed_servers"] = servers or ALLOWED_SERVERS
        if "unclassifiedColumns" in given and (mode := self.choice(given["unclassifiedColumns"], f"{path}.unclassifiedColumns", '"unclassifiedColumns"', Unclassified)):
            out["unclassified"] = mode
        if "batchSize" in given:
            n = given["batchSize"]
            if n.kind != "number":
                self.add(INVALID_TYPE, f"{path}.batchSize", n, f'"batchSize" must be a number, not {n.kind}.')
            elif not n.value.isdigit() or not 1 <= int(n.value) <= LARGEST_BATCH:
                self.add(INVALID_VALUE, f"{path}.batchSize", n, f'"batchSize" must be a whole number from 1 to {LARGEST_BATCH}, not {n.raw}.')
            else:
                out["batch_size"] = int(n.value)
        if "renameTo" in given and (name := self.text(given["renameTo"], f"{path}.renameTo", '"renameTo"')):
            out["rename_to"] = name
        if "repairUsers" in given:
            out["repair_users"] = self.texts(given["repairUsers"], f"{path}.repairUsers", '"repairUsers"') or ()
        return out

    def named(self, given: dict[str, Node], node: Node, path: str, what: str) -> str | None:
        if "name" not in given:
            self.add(MISSING_PROPERTY, f"{path}.name", node, f'{what} has no "name".')
            return None
        return self.text(given["name"], f"{path}.name", '"name"')

    def table(self, node: Node, path: str) -> TableRule | None:
        given = self.object(node, path, "A table entry", TABLE)
        if given is None:
            return None
        name = self.named(given, node, path, "A table entry")
        parts = name.split(".") if name else []
        if name and (len(parts) != 2 or not all(p.strip() for p in parts)):
            self.add(INVALID_VALUE, f"{path}.name", given["name"], f'"{name}" isn\'t of the form schema.table.')
            parts = []
        strategy = self.choice(given["strategy"], f"{path}.strategy", '"strategy"', TableStrategy) if "strategy" in given else None
        history = self.choice(given["history"], f"{path}.history", '"history"', HistoryMode) if "history" in given else None
        columns = self.columns(given["columns"], f"{path}.columns") if "columns" in given else ()
        reason = self.text(given["reason"], f"{path}.reason", '"reason"') if "reason" in given else None
        if strategy and columns:
            left = "nothing would be left to mask" if strategy is TableStrategy.TRUNCATE else "columns that come later would be kept unseen"
            self.add(CONTRADICTORY, f"{path}.columns", given["columns"], f'{name} has the strategy "{strategy.value}", so {left}.', 'Drop "columns" or "strategy".')
        if "strategy" not in given and "columns" not in given:
            self.add(CONTRADICTORY, path, node, f"{name} asks for nothing.", 'Add "strategy" or "columns".')
        if strategy is TableStrategy.KEEP and "reason" not in given:
            self.add(MISSING_PROPERTY, f"{path}.reason", node, f'{name} is kept without a "reason".')
        if len(parts) != 2:
            return None
        return TableRule(parts[0], parts[1], strategy, history or HistoryMode.TRUNCATE, columns, reason)

    def columns(self, node: Node, path: str) -> tuple[ColumnRule, ...]:
        if node.kind != "array":
            self.add(INVALID_TYPE, path, node, f'"columns" must be an array, not {node.kind}.')
            return ()
        seen: dict[str, int] = {}
        out = []
        for i, n in enumerate(node.value):
            rule = self.column(n, f"{path}[{i}]")
            if rule is None:
                continue
            if rule.name.lower() in seen:
                self.add(DUPLICATE, f"{path}[{i}].name", n.value["name"], f"{rule.name} is already at {path}[{seen[rule.name.lower()]}].")
                continue
            seen[rule.name.lower()] = i
            out.append(rule)
        return tuple(out)

    def column(self, node: Node, path: str) -> ColumnRule | None:
        given = self.object(node, path, "A column entry", COLUMN)
        if given is None:
            return None
        name = self.named(given, node, path, "A column entry")
        if "strategy" not in given:
            self.add(MISSING_PROPERTY, f"{path}.strategy", node, f'{name or "A column"} has no "strategy".')
            return None
        strategy = self.choice(given["strategy"], f"{path}.strategy", '"strategy"', Strategy)
        if strategy is None or name is None:
            return None
        reason = self.text(given["reason"], f"{path}.reason", '"reason"') if "reason" in given else None
        return ColumnRule(name, strategy, self.value(given, node, path, name, strategy), reason, self.unique(given, path, name, strategy))

    def value(self, given: dict[str, Node], node: Node, path: str, name: str, strategy: Strategy) -> StaticSpec | None:
        n = given.get("value")
        if strategy is not Strategy.STATIC:
            if n:
                self.add(VALUE_NOT_ALLOWED, f"{path}.value", n, f'{name} has the strategy "{strategy.value}", which uses no "value".')
            return None
        if n is None:
            self.add(REQUIRES_VALUE, path, node, f'{name} is "static" without a "value".')
        elif n.kind == "null":
            self.add(INVALID_VALUE, f"{path}.value", n, f"{name} can't be set to null by a value.", 'Use the strategy "null".')
        elif n.kind in ("object", "array"):
            self.add(INVALID_TYPE, f"{path}.value", n, f'The "value" of {name} must be a string, a number or a boolean, not {n.kind}.')
        else:
            return StaticSpec(n.kind, n.value if n.kind == "string" else n.raw)
        return None

    def unique(self, given: dict[str, Node], path: str, name: str, strategy: Strategy) -> bool:
        n = given.get("unique")
        if n is None:
            return False
        if n.kind != "string":
            self.add(INVALID_TYPE, f"{path}.unique", n, f'"unique" of {name} must be the string "key", not {n.kind}.')
        elif n.value != "key":
            self.add(INVALID_VALUE, f"{path}.unique", n, f'"unique" of {name} can only be "key", not "{n.value}".')
        elif strategy is not Strategy.SCRAMBLE:
            self.add(CONTRADICTORY, f"{path}.unique", n, f'{name} has the strategy "{strategy.value}", which no key can make unique.')
        else:
            return True
        return False


def load(text: str) -> RuleSet:
    """Rules from text; InvalidRules names every problem, not only the first."""
    loader = _Loader()
    try:
        root = read(text)
    except BadJson as e:
        raise InvalidRules([Problem(INVALID_JSON, "", f"The file isn't JSON: {e}.", "", e.line, e.column)]) from None
    rules = loader.rules(root)
    if loader.problems:
        raise InvalidRules(loader.problems)
    return RuleSet(**{**rules.__dict__, "hash": hashlib.sha256(text.encode()).hexdigest()})


def load_file(path: str) -> RuleSet:
    with open(path, "rb") as f:
        raw = f.read()
    rules = load(raw.decode("utf-8-sig"))
    return RuleSet(**{**rules.__dict__, "hash": hashlib.sha256(raw).hexdigest()})
