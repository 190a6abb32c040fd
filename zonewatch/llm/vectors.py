"""What the vector operators share: which vectors take part, and arrays from binary columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: id and vector not null, every component finite. v stays an
    array of floats where it is one, else it is one of doubles."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & finite & (F.size(vec_col) > 0)).select(
        F.col(id_col).alias("id"), (F.col(vec_col) if df.schema[vec_col].dataType.simpleString() == "array<float>"
                                    else F.col(vec_col).cast("array<double>")).alias("v"))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """The rows of each length of v apart, as only equally long vectors are compared: one part in a clean
    table. The lengths of the vectors at hand reach the driver, no more of them than the longest one has components."""
    lengths = sorted(r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    return [rows] if len(lengths) < 2 else [rows.where(F.size("v") == d) for d in lengths]


def stack(column, dtype) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)
