"""What the operators on vectors share: numbered rows, validity, unit vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.session import written

USABLE = (
    "coalesce(size({0}) > 0 and forall({0}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    " and exists({0}, x -> x <> 0), false)"
)


def usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    return F.expr(USABLE.format(f"`{vector}`"))


def numbered(df: DataFrame, purpose: str, **columns: str) -> DataFrame:
    """``df`` with a number ``_row`` for each row, written once, so that the numbers stay.

    ``columns`` maps new names to those of ``df``. Rows may share an id, or have none.
    """
    return written(
        df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(old).alias(new) for new, old in columns.items()]), purpose
    )


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix in double precision."""
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; by the largest component first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
