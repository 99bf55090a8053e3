"""Near-duplicate vectors with an inverted multi-index.

Two codebooks, one for each half of the normalised vectors, span a grid of cells, and every vector is listed in
its cell.  A vector visits the cells in order of the sum of its halves' squared distances to the cells' codewords,
the multi-sequence order, as many as a calibration needs for the recall that is asked for; codewords are fewer where
that costs less than visits.  In each cell the
visitors are compared with its members by their cosine, so no link below the threshold is ever made.

Equal vectors are one class throughout.  A cell's visitors and members meet in small blocks, so a crowded cell
spreads over many tasks, and a task reports only sums of links and a spanning forest of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, small_or_shuffled
from .vectors import bounded_sample, by_length, stack, usable_vectors, vector

#: Least and largest bound on the sample that codebooks and calibration are fitted on, and its rows for each codeword of a half.
SAMPLE, MOST_SAMPLE, PER_WORD = 4096, 65_536, 16
#: Vectors that a cell should hold.
PER_CELL = 8
#: Share of pairs at cosines from the threshold up to 1 that must be found; visited cells that are tried first, and how often they double.
RECALL, MOST_VISITS, DOUBLINGS = 0.98, 24, 4
#: Vectors that calibration turns away; comparisons that cost as much as bringing a vector to one more cell.
PAIRS, COPY = 512, 300
#: Vectors of a block in a cell, and rows that one Python call handles.
BLOCK, SLOT = 128, 2048


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ codewords.T + (codewords**2).sum(1)[None]


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        words = np.stack([x[near == i].mean(0) if (near == i).any() else x[rng.integers(len(x))] for i in range(k)])
    return words


class MultiIndex:
    """Codebooks of the two halves of normalised vectors."""

    def __init__(self, sample: np.ndarray, codewords: int):
        self.half = sample.shape[1] // 2
        k = max(1, min(codewords, len(sample)))
        self.books = [codebook(part, k, i) for i, part in enumerate(self.halves(sample))]
        self.k = k

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def traverse(self, x: np.ndarray, visits: int) -> Iterator[np.ndarray]:
        """Numbers of the `visits` nearest cells of each vector, nearest first: the multi-sequence algorithm on sorted distances."""
        a, b = (_distances(part, book) for part, book in zip(self.halves(x), self.books))
        ia, ib = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        for da, db, na, nb in zip(a.tolist(), b.tolist(), ia, ib):
            heap, out = [(da[0] + db[0], 0, 0)], []
            while heap and len(out) < visits:
                _, i, j = heapq.heappop(heap)
                out.append(na[i] * self.k + nb[j])
                if j + 1 < self.k:
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
                if j == 0 and i + 1 < self.k:
                    heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            yield np.array(out, np.int32)

    def visits_for(self, pairs: list[tuple[np.ndarray, np.ndarray]], recall: float, most: int) -> int | None:
        """Visits after which the share `recall` of the pairs of each kind meets; None where `most` visits fall short.

        The share is met with two standard errors to spare, as far as there are pairs enough to tell.
        """
        enough = 1
        for x, y in pairs:
            needed = []
            for va, vb in zip(self.traverse(x, most), self.traverse(y, most)):
                hits = [int(np.flatnonzero(v == home)[0]) + 1 for v, home in ((va, vb[0]), (vb, va[0])) if (v == home).any()]
                needed.append(min(hits, default=most + 1))
            share = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / len(needed)))
            enough = max(enough, int(np.quantile(needed, share, method="higher")))
        return enough if enough <= most else None


def calibration_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at cosines over the threshold, of three kinds: vectors turned anywhere, vectors turned the way that others of the sample lie, and pairs of the sample itself.

    Tables whose vectors lie near a plane of few dimensions have partners in that plane, which random turns leave.
    """
    rng = np.random.default_rng(7)
    x = sample[:PAIRS]
    c = np.linspace(threshold, 1, len(x), endpoint=False)[:, None]

    def turned(z):
        z = z - (z * x).sum(1, keepdims=True) * x
        return normalised(c * x + np.sqrt(1 - c**2) * (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)))

    pairs = [(x, turned(rng.normal(size=x.shape)))]
    if len(sample) > 1:
        a, b = (sample[rng.integers(len(sample), size=len(x))] for _ in range(2))
        pairs.append((x, turned(a - b + 1e-9 * rng.normal(size=x.shape))))
    some = sample[: 2 * SAMPLE]
    found = [np.empty((0, 2), np.int64)]
    for at in range(0, len(some), 512):
        i, j = np.nonzero(some[at : at + 512] @ some.T >= threshold)
        new = np.column_stack([i + at, j])[i + at < j]
        found.append(new[rng.permutation(len(new))[: 16 * PAIRS]])
    real = np.concatenate(found)
    if len(real):
        real = real[rng.permutation(len(real))[: 2 * PAIRS]]
        pairs.append((some[real[:, 0]], some[real[:, 1]]))
    return pairs


def codewords_for(total: int) -> int:
    """Codewords of a half: the grid grows with the table as far as the largest sample can teach them (beyond 100 million vectors cells grow)."""
    return max(1, min(MOST_SAMPLE // PER_WORD, round(math.sqrt(total / PER_CELL))))


def fitted_index(sample: np.ndarray, total: int, threshold: float, recall: float) -> tuple[MultiIndex, int]:
    """An index for `total` vectors, and visits with which it finds the share `recall` of calibration's pairs.

    Where MOST_VISITS fall short, more visits and fewer codewords are tried, and what costs least of all that reaches
    the recall is taken.  One codeword, which compares all pairs, always does.  Where the table is larger than the
    sample, calibration's vectors are not those that codebooks learn from.
    """
    learnt = sample[PAIRS:] if len(sample) >= SAMPLE else sample
    k, pairs = min(codewords_for(total), max(1, len(learnt))), calibration_pairs(sample, threshold)
    found = []
    while True:
        index = MultiIndex(learnt, k)
        for n in range(DOUBLINGS + 1):
            visits = index.visits_for(pairs, recall, MOST_VISITS << n)
            if visits is not None:
                found.append((visits * (COPY + total / index.k**2), len(found), index, visits))
                break
            if MOST_VISITS << n >= index.k**2:
                break
        if k == 1 or (visits is not None and visits <= MOST_VISITS):
            return min(found)[2:]
        k //= 2


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what earlier pairs left apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def compare_blocks(slot: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the visitors and members of each cell block in a slot: sums per vector, and forest edges."""
    sums: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for (cell, _, _), part in slot.groupby(["cell", "i", "j"], sort=False):
        q, m = part[~part.member], part[part.member]
        if not len(q) or not len(m):
            continue
        x, y = stack(q.v), stack(m.v)
        cos = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        qi, mi = np.nonzero(cos >= threshold)
        a, b = q.id.to_numpy()[qi], m.id.to_numpy()[mi]
        # A pair inside its common cell counts once; where both visit each other's cell, the smaller cell counts it.
        home = q.home.to_numpy()[qi]
        back = np.array([np.isin(q.home.to_numpy(), v) for v in m.visits]).T[qi, mi]
        keep = np.where(home == cell, a < b, (cell < home) | ~back)
        a, b, qn, mn = a[keep], b[keep], q.n.to_numpy()[qi[keep]], m.n.to_numpy()[mi[keep]]
        ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        for u, w in zip(ends.tolist(), np.bincount(at, np.concatenate([mn, qn]), len(ends)).astype(int).tolist()):
            sums[u] = sums.get(u, 0) + w
        edges += _forest(zip(a.tolist(), b.tolist()))
    edges = _forest(iter(edges))
    return pd.DataFrame({
        "a": [*sums, *(e[0] for e in edges)], "b": [*[None] * len(sums), *(e[1] for e in edges)], "links": [*sums.values(), *[0] * len(edges)],
    }).astype({"a": "int64", "b": "Int64", "links": "int64"})


def _met(classes: DataFrame, total: int, threshold: float, recall: float) -> DataFrame:
    """(a, b, links) of classes of vectors of one length: sums of links by class (b null), and pairs that join components."""
    spark = classes.sparkSession
    sample = normalised(bounded_sample(classes, min(MOST_SAMPLE, max(SAMPLE, PER_WORD * codewords_for(total))), "codebooks"))
    index, visits = fitted_index(sample, total, threshold, recall)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.traverse(normalised(stack(vectors)), visits)))

    listed = materialise(classes.select("id", "n", "v", cells(F.col("v")).alias("visits"))).withColumn("home", F.element_at("visits", 1))
    members = listed.select("id", "n", "v", "home", "visits", F.col("home").alias("cell"), F.lit(True).alias("member"))
    visitors = listed.select("id", "n", "v", "home", F.lit(None).cast("array<int>").alias("visits"), F.explode("visits").alias("cell"), F.lit(False).alias("member"))

    # Cells are at most the codewords squared; their counts are broadcast where that is few.
    counts = members.groupBy("cell").agg(F.count("*").alias("m")).join(visitors.groupBy("cell").agg(F.count("*").alias("q")), "cell")
    counts = materialise(counts.select("cell", F.ceil(F.col("q") / BLOCK).cast("int").alias("qb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mb")))
    met = members.unionByName(visitors).join(small_or_shuffled(counts), "cell")
    own = F.pmod(F.xxhash64("id", "member"), F.when(F.col("member"), F.col("mb")).otherwise(F.col("qb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("qb")).otherwise(F.col("mb")) - 1))
    met = met.withColumn("own", own).withColumn("other", other)
    met = met.withColumn("i", F.when(F.col("member"), F.col("other")).otherwise(F.col("own"))).withColumn("j", F.when(F.col("member"), F.col("own")).otherwise(F.col("other")))
    slots = max(1, math.ceil(total * (visits + 1) / SLOT))
    met = met.withColumn("slot", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(slots))).select("slot", "cell", "i", "j", "member", "id", "n", "v", "home", "visits")
    return materialise(met.groupBy("slot").applyInPandas(lambda s: compare_blocks(s, threshold), "a long, b long, links long"))


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept), by links of cosine >= threshold between vectors of one length.

    Vectors that are null, empty, all zero, or hold null or non-finite components have no links and are components of
    their own.  Rows that repeat a vector link with each other; rows that repeat an id with different vectors are different vectors.
    Rows with a null id link like others; their component is the smallest id in it, and they are kept only where it holds no id.
    """
    rows = usable_vectors(df, id_col=id_col, vector_col=vector_col)
    classes = rows.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()))
    parts = [_met(part, total, threshold, recall) for total, part in by_length(classes)]
    plain = df.select(F.col(id_col).alias("id"), vector(df, vector_col).alias("v"))
    if not parts:
        return plain.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    component = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.select("id", "least", "n").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialise(named.join(links, "id", "left"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    per_class = classes.select("id", "v").join(named, "id").select("v", "links", "component_id")
    out = plain.join(per_class, "v", "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept")
    )
