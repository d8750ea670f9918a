"""Property-graph-stream summarisation on Spark DataFrames."""

from .config import GraphConfig, WindowSpec
from .functions import Aggregate, AvgProperty, Count, CustomAggregate, MaxProperty, MinProperty, SumProperty
from .graph import PropertyGraph
from .operators import GraphGrouping, GraphOperator
from .plans import LABEL, GroupingBuilder, GroupingKey, GroupingSpec

__all__ = [
    "LABEL", "Aggregate", "AvgProperty", "Count", "CustomAggregate", "GraphConfig", "GraphGrouping", "GraphOperator",
    "GroupingBuilder", "GroupingKey", "GroupingSpec", "MaxProperty", "MinProperty", "PropertyGraph", "SumProperty", "WindowSpec",
]
