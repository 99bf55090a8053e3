"""Hard negatives with a vector-approximation file.

Components become integers, and each dimension is cut into up to 256 cells that hold about equally many of them.  The file
lists every vector as one byte a dimension, the number of its cell.  The edges of the cells, looked up by these numbers, bound the
inner product with an anchor from below and from above.  A scan of the file keeps only vectors whose bounds leave it possible
that they are among an anchor's first positives, or among the first negatives of a positive's window; only these are
scored exactly, by one join with the vectors.

Anchors and the file meet in tiles, a block of one with a group of the other, so that neither is held whole anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import vector

#: Cells of a dimension at most: their numbers are one byte.
CELLS = 256
#: Blocks of the file at least, vectors of a block and anchors of a tile at most.
BLOCKS, BLOCK, ANCHORS = 24, 65_536, 4096
#: Bounds that one step of a tile holds.
HELD = 2_000_000
#: Stands for a null id in orders: after all others.
NO_ID = 2**63 - 1

BOUNDS = "anchor long, row long, least double, most double"


@dataclass(frozen=True)
class VectorFile:
    """The cuts between a dimension's cells, and the smallest and largest integer of each cell.  Of fixed size."""

    cuts: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray

    def codes(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(self.cuts[j], q[:, j], "right") for j in range(q.shape[1])]).astype(np.uint8) if q.shape[1] else q.astype(np.uint8)

    def bounds(self, anchors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the least and the most that each anchor's product with each vector of the file can be."""
        at = np.arange(codes.shape[1])
        low, high = self.low[at, codes], self.high[at, codes]
        middle, reach = anchors @ (low + high).T, np.abs(anchors) @ (high - low).T
        return middle - reach, middle + reach


def fitted_file(rows: DataFrame) -> VectorFile:
    """Cells of each dimension from quantiles over all rows; the outermost end at the least and the greatest component."""
    asked = [c / CELLS for c in range(1, CELLS)]
    each = rows.select(F.posexplode("q").alias("at", "x")).groupBy("at")
    found = sorted(each.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", asked, 4 * CELLS).alias("cuts")).collect())
    greatest = max((max(abs(r.least), abs(r.most)) for r in found), default=0)
    if 200 * len(found) * (greatest + 1) ** 2 >= 2**53:
        raise ValueError("components are too large for products to be exact")
    # A cut is the first integer of the cell above it.
    cuts = [np.unique([c for c in r.cuts if c > r.least]).astype(np.float64) for r in found]
    low, high = np.zeros((len(found), CELLS)), np.zeros((len(found), CELLS))
    for j, (r, c) in enumerate(zip(found, cuts)):
        low[j, : len(c) + 1], high[j, : len(c) + 1] = np.append(r.least, c), np.append(c - 1, r.most)
    return VectorFile(cuts, low, high)


def kth_greatest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row of x, minus infinity where it has fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _steps(anchors: pd.DataFrame, codes: pd.DataFrame, file: VectorFile):
    """A few anchors at a time with vectors of their length: (anchors, vectors, least, most, whether labels are equal)."""
    if not len(anchors) or not len(codes):
        return
    labels = pd.factorize(pd.concat([anchors.own_label, codes.label], ignore_index=True))[0]
    anchors, codes = anchors.assign(own_label=labels[: len(anchors)]), codes.assign(label=labels[len(anchors) :])
    lengths = codes.code.map(len).to_numpy()
    for n, some in anchors.groupby(anchors.own.map(len), sort=False):
        part = codes[lengths == n]
        if not len(part):
            continue
        c = np.frombuffer(b"".join(part.code), np.uint8).reshape(len(part), n)
        step = max(1, HELD // len(part))
        for at in range(0, len(some), step):
            a = some.iloc[at : at + step]
            least, most = file.bounds(np.stack(a.own.to_numpy()).astype(np.float64).reshape(len(a), n), c)
            yield a, part, least, most, a.own_label.to_numpy()[:, None] == part.label.to_numpy()[None]


def possible_positives(anchors: pd.DataFrame, codes: pd.DataFrame, file: VectorFile, k: int) -> pd.DataFrame:
    """Vectors of the anchor's label, not its own row, that fewer than k others of the block surely come before."""
    out = [pd.DataFrame({"anchor": [], "row": [], "least": [], "most": []})]
    for a, part, least, most, same in _steps(anchors, codes, file):
        same &= a.anchor.to_numpy()[:, None] != part.row.to_numpy()[None]
        bar = kth_greatest(np.where(same, least, -np.inf), k)
        i, j = np.nonzero(same & (most >= bar[:, None]))
        out.append(pd.DataFrame({"anchor": a.anchor.to_numpy()[i], "row": part.row.to_numpy()[j], "least": least[i, j], "most": most[i, j]}))
    return pd.concat(out).astype({"anchor": "int64", "row": "int64"})


def possible_negatives(anchors: pd.DataFrame, codes: pd.DataFrame, file: VectorFile, k: int, window: tuple[int, int]) -> pd.DataFrame:
    """For each positive score of an anchor, vectors of other labels that may lie in its window, and that fewer than k sure ones of the block come before."""
    out = [pd.DataFrame({"anchor": [], "row": [], "least": [], "most": [], "positive": []})]
    for a, part, least, most, same in _steps(anchors, codes, file):
        scores = a.scores.to_numpy()
        for n in range(max(map(len, scores), default=0)):
            p = np.array([s[n] if n < len(s) else -1 for s in scores], np.float64)[:, None]
            floor, roof = window[0] * p, window[1] * p
            # Bounds are doubled, and scores count in hundredths.
            sure = (50 * least >= floor) & (50 * most <= roof) & ~same & (p >= 0)
            bar = kth_greatest(np.where(sure, least, -np.inf), k)
            i, j = np.nonzero((50 * most >= floor) & (50 * least <= roof) & ~same & (p >= 0) & (most >= bar[:, None]))
            out.append(pd.DataFrame({"anchor": a.anchor.to_numpy()[i], "row": part.row.to_numpy()[j], "least": least[i, j], "most": most[i, j], "positive": p[i, 0]}))
    return pd.concat(out).astype({"anchor": "int64", "row": "int64", "positive": "int64"})


def _scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (anchor, row) that the bounds leave, with the vector's id and its exact score."""
    near = pairs.join(rows.select("row", "id", "q"), "row").join(rows.where("asks").select(F.col("row").alias("anchor"), F.col("q").alias("aq")), "anchor")
    product = F.aggregate(F.zip_with("q", "aq", lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return near.withColumn("score", product).drop("q", "aq")


def _left(pairs: DataFrame, k: int, sure: Column, *group: str) -> DataFrame:
    """pairs that fewer than k sure ones of all blocks come before."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last("sure")))
    d = pairs.withColumn("sure", F.when(sure, F.col("least"))).withColumn("place", place)
    bar = F.max(F.when(F.col("place") == k, F.col("sure"))).over(Window.partitionBy(*group))
    return d.withColumn("bar", bar).where("bar is null or most >= bar").drop("sure", "place", "bar")


def hard_negatives(
    df: DataFrame, is_anchor, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """The first negatives in the window of each anchor's first positives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on the id.  Each component x counts as floor(scale * x); a score is the product of such vectors.  Positives are the
    anchor's best rows of its own label but itself; a negative has another label and a score from window[0] to window[1] hundredths of the positive's,
    so positives of negative score have none.  Equal scores come by smaller id, null ids last.  Rows with a null label, a null vector, or a null or
    non-finite component take no part; vectors of other lengths than the anchor's aren't compared with it; empty vectors score 0.  Rows that repeat an
    id are rows of their own.  Components are integers below 2^31 that keep products exact in doubles, and others are refused.  An empty table gives no rows.
    """
    v = vector(df, vector_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where("label is not null and v is not null")
    rows = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))
    rows = materialise(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "label", F.coalesce("id", F.lit(NO_ID)).alias("id"), F.coalesce(is_anchor(F.col("id")), F.lit(False)).alias("asks"),
            F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"),
        )
    )
    file = df.sparkSession.sparkContext.broadcast(fitted_file(rows))

    @F.pandas_udf("binary")
    def code(q: pd.Series) -> pd.Series:
        out = pd.Series([b""] * len(q), index=q.index, dtype=object)
        for _, part in q.groupby(q.map(len)):
            out[part.index] = [c.tobytes() for c in file.value.codes(np.stack(part.to_numpy()))]
        return out

    # Of equal vectors with one label, those beyond the first few by id are in no result; tasks drop them before rows move.
    place = F.row_number().over(Window.partitionBy("q", "label").orderBy("id", "row"))
    found = rows.withColumn("place", place).where(F.col("place") <= max(positives, negatives) + 1)
    listed = materialise(found.select("row", "label", code(F.col("q")).alias("code")))
    asked = materialise(rows.where("asks").select(F.col("row").alias("anchor"), F.col("label").alias("own_label"), F.col("q").alias("own")))
    blocks, groups = max(BLOCKS, math.ceil(listed.count() / BLOCK)), max(1, math.ceil(asked.count() / ANCHORS))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def scan(anchors: DataFrame, ddl: str, of_tile) -> DataFrame:
        """What a function finds in the tiles of anchors and the file."""
        dealt = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return dealt.groupBy("block", "group").cogroup(listed.groupBy("block", "group")).applyInPandas(of_tile, ddl)

    order = F.desc("score"), F.col("id"), F.col("row")
    near = _left(scan(asked, BOUNDS, lambda a, c: possible_positives(a, c, file.value, positives)), positives, F.lit(True), "anchor")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    best = materialise(_scored(near, rows).withColumn("place", place).where(F.col("place") <= positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive")))

    scores = best.where("positive >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive")).alias("scores"))
    spread = scan(asked.join(scores, "anchor"), BOUNDS + ", positive long", lambda a, c: possible_negatives(a, c, file.value, negatives, window))
    floor, roof = window[0] * F.col("positive"), window[1] * F.col("positive")
    spread = _left(spread, negatives, (50 * F.col("least") >= floor) & (50 * F.col("most") <= roof), "anchor", "positive")
    inside = _scored(spread, rows).where((100 * F.col("score") >= floor) & (100 * F.col("score") <= roof))
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))
    kept = inside.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(rows.where("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").join(kept, ["anchor", "positive"])
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return named.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), F.col("positive").alias("positive_score"), "negative_score")
