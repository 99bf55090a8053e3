"""Reading vectors: which take part, and as what."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Vectors of different lengths are handled one length after another; more lengths than this are refused as a table of something else.
MOST_LENGTHS = 64


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector(df: DataFrame, vector_col: str) -> Column:
    """The vectors as doubles, or as they are where they are floats already: these are half as large to move, and Python widens them exactly."""
    kind = df.schema[vector_col].dataType
    return F.col(vector_col) if kind.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")


def usable_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, v) of the vectors that take part, with a number of the row that stays: the rows are materialised once."""
    rows = df.select(F.col(id_col).alias("id"), vector(df, vector_col).alias("v")).where(usable(F.col("v")))
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()))


def by_length(rows: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(number, rows) of each length of v in turn, the shortest first.  Vectors of different lengths have nothing to compare."""
    lengths = sorted((r.n, r["count"]) for r in rows.groupBy(F.size("v").alias("n")).count().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    for n, count in lengths:
        yield count, rows if len(lengths) == 1 else rows.where(F.size("v") == n)


def bounded_sample(rows: DataFrame, most: int, seed: str) -> np.ndarray:
    """Up to `most` distinct vectors, those of smallest hash of row content, as a matrix on the driver."""
    got = rows.select("v").distinct().orderBy(F.xxhash64(F.lit(seed), F.col("v")), "v").limit(most).toPandas()
    return stack(got.v)


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, 1))
