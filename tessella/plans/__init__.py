"""Declarations of what to compute."""

from .spec import LABEL, GroupingBuilder, GroupingKey, GroupingSpec

__all__ = ["LABEL", "GroupingBuilder", "GroupingKey", "GroupingSpec"]
