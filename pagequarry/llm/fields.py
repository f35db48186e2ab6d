"""Schemas of what tasks in Python return."""

from __future__ import annotations

from pyspark.sql.types import DataType, StructField, StructType


def with_fields(*kept: StructField, **added: str) -> StructType:
    """The fields as they are, then new ones by name and type."""
    return StructType([*kept, *(StructField(name, DataType.fromDDL(kind)) for name, kind in added.items())])
