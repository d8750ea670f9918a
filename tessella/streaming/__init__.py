"""Structured Streaming: sinks and running to the end of what a source holds."""

from .sinks import drain, print_lines, write_lines

__all__ = ["drain", "print_lines", "write_lines"]
