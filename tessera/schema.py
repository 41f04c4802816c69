"""Tables, keys and foreign keys of a relational dataset. Driver-side metadata only."""

from __future__ import annotations

import json
import re
from collections import deque
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class ForeignKey:
    """``child(columns)`` refers to ``parent(parent_columns)``."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    cardinality: str = "1:N"
    nullable: bool = True
    confidence: float = 1.0
    source: str = "user"

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)})->{self.parent}({','.join(self.parent_columns)})"


@dataclass
class Table:
    name: str
    columns: dict[str, str] = field(default_factory=dict)  # column -> bool, int, float, datetime or str
    key: tuple[str, ...] = ()


class Graph:
    """Tables by name and their foreign keys. Self-references are allowed; other cycles are faults."""

    def __init__(self, tables: list[Table] | None = None, keys: list[ForeignKey] | None = None):
        self.tables = {t.name: t for t in tables or []}
        self.keys = list(keys or [])

    def parents(self, table: str) -> list[ForeignKey]:
        return [k for k in self.keys if k.child == table]

    def children(self, table: str) -> list[ForeignKey]:
        return [k for k in self.keys if k.parent == table]

    def path(self, start: str, end: str) -> list[ForeignKey] | None:
        """The shortest chain of foreign keys upward from ``start`` to ``end``; self-references are skipped."""
        if start == end:
            return []
        seen, queue = {start}, deque([(start, [])])
        while queue:
            table, chain = queue.popleft()
            for k in self.parents(table):
                if k.parent == end and k.parent != table:
                    return [*chain, k]
                if k.parent not in seen:
                    seen.add(k.parent)
                    queue.append((k.parent, [*chain, k]))
        return None

    def ancestors(self, table: str, depth: int = 3) -> list[str]:
        """Tables above ``table``, nearest first, up to ``depth`` hops."""
        found, level = [], [table]
        for _ in range(depth):
            level = [k.parent for t in level for k in self.parents(t) if k.parent != t]
            level = [t for t in dict.fromkeys(level) if t not in found and t != table]
            found += level
        return found

    def order(self) -> list[str]:
        """Parents before children, ties by name order of declaration; raises on a cycle."""
        left = {t: {k.parent for k in self.parents(t)} - {t} for t in self.tables}
        out: list[str] = []
        while left:
            ready = [t for t, above in left.items() if not above & left.keys()]
            if not ready:
                raise ValueError(f"foreign keys form a cycle among {sorted(left)}")
            out += ready
            for t in ready:
                del left[t]
        return out

    def faults(self) -> list[str]:
        """What is wrong with the graph; empty if nothing."""
        out = []
        for k in self.keys:
            for t, cols in ((k.child, k.columns), (k.parent, k.parent_columns)):
                if t not in self.tables:
                    out.append(f"{k.name}: no table {t}")
                elif missing := [c for c in cols if self.tables[t].columns and c not in self.tables[t].columns]:
                    out.append(f"{k.name}: {t} has no column {', '.join(missing)}")
            if k.parent in self.tables and self.tables[k.parent].key and set(self.tables[k.parent].key) != set(k.parent_columns):
                out.append(f"{k.name}: does not refer to the key of {k.parent}")
        try:
            self.order()
        except ValueError as e:
            out.append(str(e))
        return out

    def many_to_many(self) -> list[dict[str, str]]:
        """Junction tables: those whose key is made of two foreign keys."""
        out = []
        for t in self.tables.values():
            ups = [k for k in self.parents(t.name) if set(k.columns) <= set(t.key)]
            if len(ups) == 2 and {c for k in ups for c in k.columns} == set(t.key):
                out.append({"junction": t.name, "left": ups[0].parent, "right": ups[1].parent})
        return out

    def add(self, key: ForeignKey) -> ForeignKey:
        if any(k.name == key.name for k in self.keys):
            raise ValueError(f"{key.name} is there already")
        self.keys.append(key)
        if faults := self.faults():
            self.keys.pop()
            raise ValueError("; ".join(faults))
        return key

    def remove(self, name: str) -> None:
        if all(k.name != name for k in self.keys):
            raise KeyError(name)
        self.keys = [k for k in self.keys if k.name != name]

    def update(self, name: str, **changes) -> ForeignKey:
        i = next(i for i, k in enumerate(self.keys) if k.name == name)
        self.keys[i] = replace(self.keys[i], **changes, source="user")
        return self.keys[i]

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()], "keys": [asdict(k) for k in self.keys]})

    @classmethod
    def from_json(cls, text: str) -> Graph:
        raw = json.loads(text)
        tables = [Table(t["name"], t["columns"], tuple(t["key"])) for t in raw["tables"]]
        keys = [ForeignKey(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in raw["keys"]]
        return cls(tables, keys)


def family(spark_type: str) -> str:
    """One of five coarse families for a Spark type name."""
    base = spark_type.lower()
    if base == "boolean":
        return "bool"
    if base in {"byte", "short", "int", "integer", "long", "bigint", "smallint", "tinyint"}:
        return "int"
    if base.startswith(("float", "double", "decimal")):
        return "float"
    if base.startswith(("date", "timestamp")):
        return "datetime"
    return "str"


def normal(name: str) -> str:
    """An identifier in lower case with other characters as underscores."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def singular(name: str) -> str:
    name = normal(name)
    if name.endswith("ies"):
        return name[:-3] + "y"
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name
