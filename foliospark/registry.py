"""Named column builders by document type, merged by inheritance, and the planner over them.

A node turns other nodes into a column. A document type has nodes of its own, parents, and falls back
to ``*``: the merge order is ``*``, then the parents from last to first, then the type itself. The
planner emits one ``select`` for a set of nodes; where types differ, the column is a ``when`` over the
document type, so Catalyst prunes whatever isn't asked for. Configuration is a node too: an
instance's value goes before an operator's, which goes before a class member's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConfigurationError(Exception):
    """A pipeline without nodes, or an unknown node."""


class OperatorError(Exception):
    """An operator that failed."""


@dataclass(frozen=True)
class Node:
    """``build`` gets a function from node name to column."""

    name: str
    build: Callable[[Callable[[str], Column]], Column]
    dtype: str = "string"
    doc: str = ""
    inputs: tuple[str, ...] = ()
    default: Any = None
    memo: bool = False
    config: bool = False

    def column(self, of: Callable[[str], Column]) -> Column:
        out = self.build(of)
        return out if self.default is None else F.coalesce(out, F.lit(self.default))


def node(name: str, build: Callable, dtype: str = "string", doc: str = "", inputs: Iterable[str] = (), default: Any = None, memo: bool = False) -> Node:
    return Node(name, build, dtype, doc, tuple(inputs), default, memo)


def alias(**names: str) -> list[Node]:
    """new='old' nodes."""
    return [Node(new, lambda of, old=old: of(old), "=" + old, f"alias of {old}", (old,)) for new, old in names.items()]


def constant(**values: Any) -> list[Node]:
    return [Node(k, lambda of, v=v: F.lit(v), type(v).__name__, "constant") for k, v in values.items()]


def configuration(**values: Any) -> list[Node]:
    """Literals that ``Pipelines.with_config`` can override."""
    return [Node(k, lambda of, v=v: F.lit(v), type(v).__name__, "configuration", config=True) for k, v in values.items()]


@dataclass
class Pipelines:
    """Document types with their nodes and parents."""

    own: dict[str, list[Node]]
    parents: dict[str, tuple[str, ...]] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not any(self.own.values()):
            raise ConfigurationError("no nodes")

    def extend(self, own: dict[str, list[Node]], parents: dict[str, tuple[str, ...]] | None = None) -> Pipelines:
        """A derived registry: nodes of the same type and name are replaced, others added."""
        merged = {t: list(n) for t, n in self.own.items()}
        for t, nodes in own.items():
            merged[t] = [*merged.get(t, []), *nodes]
        return Pipelines(merged, self.parents | (parents or {}), dict(self.config))

    def with_config(self, **values: Any) -> Pipelines:
        names = {n.name for nodes in self.own.values() for n in nodes if n.config}
        if unknown := set(values) - names:
            raise ConfigurationError(f"no configuration named {sorted(unknown)}")
        return Pipelines(self.own, self.parents, self.config | values)

    def types(self) -> list[str]:
        return sorted({*self.own, *self.parents})

    def nodes(self, kind: str) -> dict[str, Node]:
        """The merged nodes of a type; an unknown type has those of ``*``."""
        out: dict[str, Node] = {}
        for t in ("*", *reversed(self.parents.get(kind, ())), kind):
            if t != "*" or not out:
                out |= {n.name: n for n in self.own.get(t, [])}
        return {k: Node(k, lambda of, v=self.config[k]: F.lit(v), n.dtype, n.doc, config=True) if n.config and k in self.config else n for k, n in out.items()}

    def column(self, name: str, kind: str, base: Iterable[str] = ()) -> Column:
        """The column of a node for one type; ``base`` names columns of the input itself."""
        nodes, open_ = self.nodes(kind), []
        base = set(base)

        def of(n: str) -> Column:
            if n in open_:
                raise ConfigurationError(f"{n} depends on itself")
            if n not in nodes:
                if n in base:
                    return F.col(n)
                raise ConfigurationError(f"{kind} has no node {n}")
            open_.append(n)
            try:
                return nodes[n].column(of)
            finally:
                open_.pop()

        return of(name)

    def plan(self, df: DataFrame, names: Iterable[str], kinds: Iterable[str] | None = None, type_column: str = "document_type") -> list[Column]:
        """One column for each node: by the row's type where the types differ, null where a type
        has no such node."""
        kinds, out = list(kinds if kinds is not None else self.types()), []
        for name in names:
            by: dict[Any, list[str]] = {}
            for k in kinds:
                n = self.nodes(k).get(name)
                if n is not None:
                    by.setdefault(tuple(sorted((x, id(y.build)) for x, y in self._closure(k, name).items())), []).append(k)
            if not by:
                if name in df.columns:
                    out.append(F.col(name))
                    continue
                raise ConfigurationError(f"no node named {name}")
            groups = list(by.values())
            if len(groups) == 1 and len(groups[0]) == len(kinds):
                out.append(self.column(name, groups[0][0], df.columns).alias(name))
                continue
            fallback = next((g for g in groups if "*" in g), None)
            col = None
            for g in groups:
                if g is not fallback:
                    test = F.col(type_column).isin(*g)
                    value = self.column(name, g[0], df.columns)
                    col = F.when(test, value) if col is None else col.when(test, value)
            if fallback:
                value = self.column(name, "*", df.columns)
                col = value if col is None else col.otherwise(value)
            out.append(col.alias(name))
        return out

    def _closure(self, kind: str, name: str) -> dict[str, Node]:
        nodes, out, todo = self.nodes(kind), {}, [name]
        while todo:
            n = todo.pop()
            if n in nodes and n not in out:
                out[n] = nodes[n]
                todo += nodes[n].inputs
        return out

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """(document_type, node, dtype, config, inputs, doc) of every node after the merge."""
        rows = [(k, n.name, n.dtype, n.config, list(n.inputs), n.doc) for k in self.types() for n in self.nodes(k).values()]
        return spark.createDataFrame(rows, "document_type string, node string, dtype string, config boolean, inputs array<string>, doc string")

    def dot(self, kind: str) -> str:
        """The nodes of a type as a DOT graph."""
        edges = [f'  "{i}" -> "{n.name}";' for n in self.nodes(kind).values() for i in n.inputs]
        return "\n".join([f'digraph "{kind}" {{', *edges, "}"])
