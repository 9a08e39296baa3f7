"""Sequence-graph assembly and data-parallel primitives as Spark DataFrame operators."""

__version__ = "0.1.0"
