"""Aggregates over the elements of a group; each is one built-in aggregate Column."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Aggregate(ABC):
    """``output_key`` names the property of the super element; ``property_key`` the property read, None for none."""

    def __init__(self, output_key: str, property_key: str | None = None):
        if not output_key:
            raise ValueError("an aggregate needs a property key for its result")
        self.output_key, self.property_key = output_key, property_key

    @abstractmethod
    def column(self, values: Column | None) -> Column:
        """The aggregate of the values; None where no property is read."""


class Count(Aggregate):
    """Number of elements, long."""

    def __init__(self, output_key: str = "count"):
        super().__init__(output_key)

    def column(self, values: Column | None) -> Column:
        return F.count(F.lit(1))


class _OfProperty(Aggregate):
    prefix: str
    aggregate: Callable[[Column], Column]

    def __init__(self, property_key: str, output_key: str | None = None):
        if not property_key:
            raise ValueError(f"{type(self).__name__} needs a property key")
        super().__init__(output_key or f"{self.prefix}_{property_key}", property_key)

    def column(self, values: Column | None) -> Column:
        return type(self).aggregate(values)


class SumProperty(_OfProperty):
    """Sum of the values present; null if none is."""

    prefix, aggregate = "sum", staticmethod(F.sum)


class MinProperty(_OfProperty):
    prefix, aggregate = "min", staticmethod(F.min)


class MaxProperty(_OfProperty):
    prefix, aggregate = "max", staticmethod(F.max)


class AvgProperty(_OfProperty):
    """Mean of the values present, double; null if none is."""

    prefix, aggregate = "avg", staticmethod(F.avg)


class CustomAggregate(Aggregate):
    """Any aggregate Column of the values of one property, or of nothing."""

    def __init__(self, output_key: str, function: Callable[[Column | None], Column], property_key: str | None = None):
        super().__init__(output_key, property_key)
        self.function = function

    def column(self, values: Column | None) -> Column:
        return self.function(values)
