"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order of its nearest pivots, and posted in the inverted files of the first few of
them, with its order.  A query orders all pivots, reads the lists of its nearest ones, and ranks their vectors by the
induced footrule distance: the sum, over the pivots that a vector lists, of the difference between the pivot's
place there and its place in the query's order.  Vectors within the query's footrule radius are ranked again by the
exact inner product.

How many lists a query reads, and how large its radius is, are fitted on a bounded sample by brute force, so that
nearest neighbours of the sample are found with the recall that is asked for.  Tables that fall into clusters need few lists;
in one whose vectors point everywhere alike most lists matter to a query, and the fit says so.

Longer vectors have larger inner products in every direction.  So vectors are indexed in bands of like norm, each with pivots, lists and radius of its
own, and a query asks every band.  Within a band a last component that brings all vectors to the largest norm
(and is 0 for queries) turns the order by inner product into one by angle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import inline_table, materialise
from .vectors import bounded_sample, by_length, stack, usable_vectors

#: The bound on the sample that pivots are picked from and that lists and radius are fitted on, and its rows that serve as queries there.
SAMPLE, TRIALS = 4096, 512
#: Pivots; how many of them stand in a vector's order; in how many of their lists it is posted.
PIVOTS, LISTED, POSTED = 1024, 16, 2
#: Cosine above which a vector is no pivot beside another.
ALIKE = 0.5
#: Ratio of the largest norm of a band to the least, and bands at most, the last one for all shorter vectors.
BAND, BANDS = 1.25, 12
#: Share of nearest neighbours that the lists read must hold, and of those that the radius must hold.
RECALL = 0.975
#: Postings and queries of one task.
BLOCK, QUERIES = 8192, 4096
#: Queries that meet a list at a time, and scores that are held before only each query's best stay.
READERS, HELD = 512, 500_000


def pick_pivots(unit: np.ndarray, most: int) -> list[int]:
    """Up to `most` places of unit vectors that point in different directions, so that no dense group takes up the pivots."""
    free, picked = np.ones(len(unit), bool), []
    for i in range(len(unit)):
        if free[i] and len(picked) < most:
            picked.append(i)
            free &= unit @ unit[i] <= ALIKE
    return picked


@dataclass(frozen=True)
class PermutationIndex:
    """Pivots and what was fitted on the sample.  Of fixed size."""

    pivots: np.ndarray
    norm: float
    listed: int
    posted: int
    #: Lists that a query reads, and the share of the sample that its radius takes in.
    lists: int
    share: float
    sample_orders: np.ndarray

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(1)))])

    def orders(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        return np.argsort(-(self.padded(x) @ self.pivots.T), axis=1, kind="stable")[:, : self.listed].astype(np.int16)

    def places(self, queries: np.ndarray) -> np.ndarray:
        """The place of every pivot (first axis) in each query's order."""
        order = np.argsort(-(queries @ self.pivots[:, :-1].T), axis=1, kind="stable")
        out = np.empty(order.shape, np.int16)
        np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None], 1)
        return np.ascontiguousarray(out.T)

    def radii(self, places: np.ndarray) -> np.ndarray:
        """For each query the footrule distance that takes in `share` of the sample."""
        n = len(self.sample_orders)
        nth = min(n - 1, math.ceil(self.share * n))
        parts = [np.partition(footrule(places[:, at : at + 64], self.sample_orders), nth, axis=0)[nth] for at in range(0, places.shape[1], 64)]
        return np.concatenate(parts) if parts else np.empty(0, np.int16)


def footrule(places: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Induced footrule distance of each order (first axis) to each query, given its pivots' places; at most PIVOTS * LISTED."""
    out = np.zeros((len(orders), places.shape[1]), np.int16)
    for j in range(orders.shape[1]):
        step = places[orders[:, j]]
        step -= np.int16(j)
        out += np.abs(step, out=step)
    return out


def fitted_index(sample: np.ndarray, norm: float, total: int, k: int, pivots: int = PIVOTS, listed: int = LISTED, recall: float = RECALL) -> PermutationIndex:
    """An index whose lists and radius hold the share `recall` of the trial queries' nearest neighbours in the sample.

    As many neighbours count as the k nearest of the whole table leave in the sample, one at least.
    """
    index = PermutationIndex(np.empty((0, 0)), norm, 1, 1, 1, 1.0, np.empty((0, 1), np.int16))
    whole = index.padded(sample)
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    # Directions are those of the vectors themselves: what brings them to one norm is alike in all.
    own = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = unit[pick_pivots(own[: max(1, len(own) - TRIALS)], max(1, min(pivots, len(sample) // 4)))]
    listed, posted = min(listed, len(chosen)), min(POSTED, len(chosen))
    index = PermutationIndex(chosen, norm, listed, posted, len(chosen), 1.0, np.empty((0, 1), np.int16))
    # Trial queries are rows that pivots weren't picked from: a pivot finds its own list at once.
    orders, trials = index.orders(sample), sample[len(chosen) :][-TRIALS:]
    places = index.places(trials)
    near = trials @ sample.T
    near[np.arange(len(trials)), np.arange(len(sample) - len(trials), len(sample))] = -np.inf
    wanted = min(len(sample) - 1, max(1, math.ceil(k * len(sample) / max(total, 1))))
    lists, shares = [], []
    for q, scores in enumerate(near):
        best = np.argpartition(-scores, wanted - 1)[:wanted] if wanted else []
        away = footrule(places[:, q : q + 1], orders)[:, 0]
        ranked = np.sort(away)
        for v in best:
            lists.append(int(places[orders[v, :posted], q].min()) + 1)
            shares.append(np.searchsorted(ranked, away[v], "right") / len(ranked))
    if not lists:
        return PermutationIndex(chosen, norm, listed, posted, len(chosen), 1.0, orders)
    need, share = int(np.quantile(lists, recall, method="higher")), float(np.quantile(shares, recall, method="higher"))
    return PermutationIndex(chosen, norm, listed, posted, need, share, orders)


FOUND = "query_row long, query_id long, vec_id long, score double"


def best_of(who: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order; ties at smaller vec_id."""
    order = np.lexsort((vec_id, -score, who))
    start = np.append(True, who[order][1:] != who[order][:-1]) if len(order) else np.empty(0, bool)
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else order
    order = order[nth < k]
    return who[order], vec_id[order], score[order]


def search_lists(queries: pd.DataFrame, posts: pd.DataFrame, index: PermutationIndex, k: int) -> pd.DataFrame:
    """The k best vectors that some lists, or blocks of them, hold for each query that reads them; never the query's own row."""
    q, radius, q_row = stack(queries.q), queries.radius.to_numpy(), queries.query_row.to_numpy()
    places = index.places(q)
    kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    new, held, least = [], 0, np.full(len(q), -np.inf)  # least: the k-th best score so far
    for pivot, part in posts.groupby("pivot", sort=False):
        readers = np.flatnonzero(places[pivot] < index.lists)
        orders, x = np.stack(part.order.to_numpy()), stack(part.v)
        row, vec_id = part.row.to_numpy(), part.id.to_numpy()
        for at in range(0, len(readers), READERS):
            who = readers[at : at + READERS]
            seen = places[:, who]
            near = footrule(seen, orders) <= radius[who]
            # A vector is looked at in the first list that both it and the query name.
            for n in range(index.posted):
                near &= seen[orders[:, n]] >= seen[pivot]
            j, i = np.nonzero(near)
            score = np.einsum("ij,ij->i", q[who[i]], x[j])
            fine = (score >= least[who[i]]) & (row[j] != q_row[who[i]])
            new.append((who[i[fine]], vec_id[j[fine]], score[fine]))
            held += len(new[-1][0])
            if held > HELD:
                kept, new, held = best_of(*(np.concatenate(c) for c in zip(kept, *new)), k), [], 0
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(q)) == k)
                least[full] = kept[2][np.searchsorted(kept[0], full, "right") - 1]
    who, vec_id, score = best_of(*(np.concatenate(c) for c in zip(kept, *new)), k)
    return pd.DataFrame({"query_row": q_row[who], "query_id": queries.query_id.to_numpy()[who], "vec_id": vec_id, "score": score})


def _search_length(rows: DataFrame, k: int, recall: float) -> list[DataFrame]:
    """What each band of vectors of one length holds for the queries of that length."""
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    norm = rows.agg(F.max("norm")).first()[0]
    band = F.least(F.floor(F.log(F.lit(norm) / F.col("norm")) / math.log(BAND)), F.lit(BANDS - 1)).cast("int")
    rows = rows.withColumn("band", band)
    bands = sorted((r.band, r["count"], r.norm) for r in rows.groupBy("band").agg(F.count("*").alias("count"), F.max("norm").alias("norm")).collect())
    return [_search_band(rows if len(bands) == 1 else rows.where(F.col("band") == b), rows, most, count, k, recall) for b, count, most in bands]


def _search_band(rows: DataFrame, queries: DataFrame, norm: float, total: int, k: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    index = fitted_index(bounded_sample(rows, SAMPLE, "pivots"), norm, total, k, recall=recall)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def orders(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.orders(stack(vectors)).astype(np.int32)), dtype=object)

    @F.pandas_udf("lists array<int>, radius int")
    def read(vectors: pd.Series) -> pd.DataFrame:
        places = shared.value.places(stack(vectors))
        lists = np.argsort(places.T, axis=1)[:, : shared.value.lists].astype(np.int32)
        return pd.DataFrame({"lists": list(lists), "radius": shared.value.radii(places)})

    posts = rows.select("row", "id", "v", orders(F.col("v")).alias("order"))
    posts = materialise(posts.withColumn("pivot", F.explode(F.slice("order", 1, index.posted))))
    # Lists of a bounded number of pivots: short ones share a task, long ones are split.
    blocks, room, where = 0, 0, []
    for r in sorted(posts.groupBy("pivot").count().collect()):
        parts = math.ceil(r["count"] / BLOCK)
        if parts > 1 or room + r["count"] > BLOCK:
            blocks, room = blocks + (room > 0), 0
        where.append({"pivot": r.pivot, "first": blocks, "parts": parts})
        blocks, room = (blocks + parts, 0) if parts > 1 else (blocks, room + r["count"])
    place = F.broadcast(inline_table(spark, where, "pivot int, first int, parts int"))
    posts = posts.join(place, "pivot").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("first", "parts")

    asked = materialise(queries.where("asks").withColumn("to", read(F.col("v"))))
    groups = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("pivot", F.explode("to.lists")).join(place, "pivot")
    asked = asked.withColumn("block", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
    asked = asked.groupBy(F.col("row").alias("query_row"), "block").agg(*[F.first(c).alias(to) for c, to in (("id", "query_id"), ("v", "q"), ("to.radius", "radius"), ("group", "asked"))])
    posts = posts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def grouped(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return search_lists(q, p, shared.value, k) if len(q) and len(p) else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})

    return asked.groupBy("block", "asked").cogroup(posts.groupBy("block", "group")).applyInPandas(grouped, FOUND)


#: Stands for a null id while vectors are ranked, after all others of equal score.
NO_ID = 2**63 - 1


def search(df: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """The k vectors of largest inner product found for each query row: (query_id, rank, vec_id, score).

    is_query is a condition on the id, which is a long; rows with a null id are candidates only, and of equal scores come last, while others
    rank by smaller id.  Candidates are all rows of the query's length but its own.  Vectors that are null, empty, all zero, or hold null or
    non-finite components take no part.  Rows that repeat an id are separate queries and candidates.  An empty table gives no rows.
    """
    rows = usable_vectors(df, id_col=id_col, vector_col=vector_col).withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False)))
    rows = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    parts = [found for _, part in by_length(rows) for found in _search_length(part, k, recall)]
    found = parts[0] if parts else df.sparkSession.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
