"""Operators from graph to graph."""

from .base import GraphOperator
from .grouping import GraphGrouping

__all__ = ["GraphGrouping", "GraphOperator"]
