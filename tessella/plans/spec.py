"""What a grouping groups by and aggregates: checked and immutable before any plan is made."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column

from ..config import WindowSpec
from ..functions.aggregates import Aggregate

#: The grouping key that stands for the label.
LABEL = ":label"


@dataclass(frozen=True)
class GroupingKey:
    """A key computed from an element. ``of`` takes the label and a function that gives a property by its name, and returns a Column."""

    name: str
    of: Callable[[Column, Callable[[str], Column]], Column]


def _name(key: str | GroupingKey) -> str:
    return key.name if isinstance(key, GroupingKey) else key


def _checked(keys: Iterable[str | GroupingKey], aggregates: Iterable[Aggregate], what: str) -> tuple[tuple[str | GroupingKey, ...], tuple[Aggregate, ...]]:
    given, aggregates = tuple(keys), tuple(aggregates)
    keys = tuple(map(_name, given))
    for k in keys:
        if not isinstance(k, str) or not k:
            raise ValueError(f"a {what} grouping key must be a non-empty string or a GroupingKey, not {k!r}")
    for a in aggregates:
        if not isinstance(a, Aggregate):
            raise TypeError(f"a {what} aggregate must be an Aggregate, not {a!r}")
    names = [k for k in keys if k != LABEL] + [a.output_key for a in aggregates]
    if len(set(keys)) < len(keys) or len(set(names)) < len(names):
        raise ValueError(f"{what} grouping keys and aggregates must have different property keys: {', '.join(names)}")
    return given, aggregates


@dataclass(frozen=True)
class GroupingSpec:
    """Keys (``:label``, properties or ``GroupingKey``) and aggregates of vertices and edges, and the window.

    ``property_types`` declares types for properties held in maps. ``mapping``: ``distinct`` maps a vertex to each of its super
    vertices once; ``bag`` once for each of its versions, so that its edges count as often. ``unique_edges`` promises that no
    edge repeats, ``consistent_vertices`` that each vertex of a triple has one version in the edge's window; both save work.
    ``write_vertices`` writes the deduplicated vertices of a bounded graph, with keys and aggregated properties alone, to a table in the
    shared folder when the graph is grouped; else the source is read and deduplicated for super vertices and again for the mapping.
    """

    vertex_keys: tuple[str | GroupingKey, ...] = ()
    vertex_aggregates: tuple[Aggregate, ...] = ()
    edge_keys: tuple[str | GroupingKey, ...] = ()
    edge_aggregates: tuple[Aggregate, ...] = ()
    window: WindowSpec = field(default_factory=WindowSpec)
    property_types: Mapping[str, str] = field(default_factory=dict)
    id_scheme: str = "escaped"
    mapping: str = "distinct"
    unique_edges: bool = False
    consistent_vertices: bool = False
    write_vertices: bool = False

    def __post_init__(self) -> None:
        for what in ("vertex", "edge"):
            keys, aggregates = _checked(getattr(self, f"{what}_keys"), getattr(self, f"{what}_aggregates"), what)
            object.__setattr__(self, f"{what}_keys", keys)
            object.__setattr__(self, f"{what}_aggregates", aggregates)
        object.__setattr__(self, "property_types", MappingProxyType(dict(self.property_types)))
        if self.mapping not in ("distinct", "bag"):
            raise ValueError(f"mapping must be distinct or bag, not {self.mapping!r}")
        if self.id_scheme not in ("escaped", "plain"):
            raise ValueError(f"id scheme must be escaped or plain, not {self.id_scheme!r}")

    def properties(self, what: str) -> list[str]:
        """Names of the grouping properties of vertices or edges, without the label."""
        return [_name(k) for k in getattr(self, f"{what}_keys") if k != LABEL]

    def values(self, what: str, label: Column, value: Callable[[str], Column]) -> list[Column]:
        """Values of these, from an element's label and a function that gives its properties."""
        return [k.of(label, value) if isinstance(k, GroupingKey) else value(k) for k in getattr(self, f"{what}_keys") if k != LABEL]

    def by_label(self, what: str) -> bool:
        return LABEL in getattr(self, f"{what}_keys")


class GroupingBuilder:
    """Collects a ``GroupingSpec`` step by step; ``build`` makes the operator."""

    def __init__(self) -> None:
        self._keys: dict[str, list[str | GroupingKey]] = {"vertex": [], "edge": []}
        self._aggregates: dict[str, list[Aggregate]] = {"vertex": [], "edge": []}
        self._window, self._options = WindowSpec(), {}

    def _add(self, store: dict, what: str, values: Iterable) -> GroupingBuilder:
        values = list(values)
        if any(v is None for v in values):
            raise ValueError(f"None is no {what} grouping key or aggregate")
        store[what] += values
        return self

    def add_vertex_grouping_key(self, key: str | GroupingKey) -> GroupingBuilder:
        return self._add(self._keys, "vertex", [key])

    def add_vertex_grouping_keys(self, keys: Iterable[str | GroupingKey]) -> GroupingBuilder:
        return self._add(self._keys, "vertex", keys)

    def add_edge_grouping_key(self, key: str | GroupingKey) -> GroupingBuilder:
        return self._add(self._keys, "edge", [key])

    def add_edge_grouping_keys(self, keys: Iterable[str | GroupingKey]) -> GroupingBuilder:
        return self._add(self._keys, "edge", keys)

    def add_vertex_aggregate(self, aggregate: Aggregate) -> GroupingBuilder:
        return self._add(self._aggregates, "vertex", [aggregate])

    def add_edge_aggregate(self, aggregate: Aggregate) -> GroupingBuilder:
        return self._add(self._aggregates, "edge", [aggregate])

    def set_window_size(self, value: int, unit: str = "seconds") -> GroupingBuilder:
        self._window = WindowSpec(value, unit)
        return self

    def options(self, **options) -> GroupingBuilder:
        """Further fields of ``GroupingSpec``."""
        self._options |= options
        return self

    def spec(self) -> GroupingSpec:
        return GroupingSpec(
            tuple(self._keys["vertex"]), tuple(self._aggregates["vertex"]), tuple(self._keys["edge"]), tuple(self._aggregates["edge"]), self._window, **self._options
        )

    def build(self):
        from ..operators.grouping import GraphGrouping

        return GraphGrouping(self.spec())
