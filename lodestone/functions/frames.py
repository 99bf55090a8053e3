"""DataFrames as wholes: cutting lineage, and numbering rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """df, made once: a reliable checkpoint in the folder that spark.checkpoint.dir names.

    A temporary folder is set only where none is named and all tasks run in one process; on a cluster a folder must be named.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoints-"))
    return df.checkpoint(eager=True)


#: Rows of one task of work that is much dearer than reading its rows.
TASK_ROWS = 50_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """df in partitions of at most about `rows` rows, at least one for each core, whatever the files and row groups that it comes from.

    For work that is much dearer than reading its rows, such as reading Markdown: how a file splits says little of how many rows a task gets.  The count
    reads no columns of a table, and the shuffle moves only those that are used.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def numbered(df: DataFrame, *order: Column | str, to: str = "i") -> DataFrame:
    """df in order with a gapless 0-based number of each row.

    One range-partitioned sort, materialised, so that places in partitions and the partitions' counts are of the same rows; the counts are
    one row for each partition.
    """
    placed = materialised((df.orderBy(*order) if order else df).withColumn("place_", F.monotonically_increasing_id()))
    part = F.shiftright("place_", 33)
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("n_")).withColumn("before_", before)
    joined = placed.withColumn("part_", part).join(F.broadcast(counts), "part_")
    number = F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(to, number).drop("part_", "place_", "n_", "before_")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that a generator makes: to the optimiser they stay columns, and it doesn't put what makes them in the place of each use, inside lambdas too."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def kept(df: DataFrame, **columns: Column) -> DataFrame:
    """held, with the columns made by a projection that the generator hands on: such columns are made in generated code but for lambdas, which a generator walks as a tree."""
    made = df.select("*", *[c.alias(f"{name}_made") for name, c in columns.items()])
    return made.select(*df.columns, F.inline(F.array(F.struct(*[F.col(f"{name}_made").alias(name) for name in columns]))))
