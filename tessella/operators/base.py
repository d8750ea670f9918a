"""What a graph operator is."""

from __future__ import annotations

from typing import TYPE_CHECKING, Protocol, runtime_checkable

if TYPE_CHECKING:
    from ..graph import PropertyGraph


@runtime_checkable
class GraphOperator(Protocol):
    """Anything with ``execute`` from graph to graph; ``PropertyGraph.apply`` takes it."""

    def execute(self, graph: PropertyGraph) -> PropertyGraph: ...
