"""Aggregates, identifiers and printable forms."""

from .aggregates import Aggregate, AvgProperty, Count, CustomAggregate, MaxProperty, MinProperty, SumProperty

__all__ = ["Aggregate", "AvgProperty", "Count", "CustomAggregate", "MaxProperty", "MinProperty", "SumProperty"]
