"""Sharding by a histogram sort.

Rows are ordered by a key of three hashes: of the text, of the id, and of the row's position in its
partition (which only ever separates identical rows).  Rounds of exact counting place the shard
boundaries: each round counts rows and bytes between candidate key boundaries (probes) on every
partition, sums them, and puts new probes inside the few intervals that still hold a boundary out of
tolerance or too many rows for one task.  Then rows move once, to the task of their interval.

Only the counts of a bounded number of intervals reach the driver, never rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import inline_table, materialise

KEYS = ("k1", "k2", "k3")


def _positive(h):
    return F.shiftrightunsigned(h, 1)


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Size in bytes, checksum and sort key of every row, materialised once.  A null text has no bytes, a null checksum."""
    text = F.col(text_col)
    return materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            _positive(F.xxhash64(text)).alias("k1"),
            _positive(F.xxhash64(F.lit("id"), F.col(id_col))).alias("k2"),
            _positive(F.xxhash64(F.lit("row"), F.monotonically_increasing_id())).alias("k3"),
            *[F.col(c).alias(f"carry_{c}") for c in carry],
        )
    )


def _counts(rows: DataFrame) -> list[dict]:
    aggs = [F.count("*").alias("rows"), F.sum("size").alias("bytes")]
    aggs += [f(k).alias(f"{n}_{k}") for k in KEYS for n, f in (("min", F.min), ("max", F.max))]
    return [r.asDict() for r in rows.groupBy("iv").agg(*aggs).collect()]


def _probe(leaf: dict, probes: int) -> dict | None:
    """Where to put probes inside an interval: over the first key that still varies in it."""
    for n, k in enumerate(KEYS):
        lo, hi = leaf[f"min_{k}"], leaf[f"max_{k}"]
        if lo < hi:
            return {"iv": leaf["iv"], "key": n, "lo": lo, "width": (hi - lo) // probes + 1}
    return None


def _split(rows: DataFrame, table: list[dict]) -> DataFrame:
    """Moves the rows of the refined intervals to their sub-intervals."""
    cuts = F.broadcast(inline_table(rows.sparkSession, table, "iv long, key int, lo long, width long, base long"))
    value = F.when(F.col("key") == 0, F.col("k1")).when(F.col("key") == 1, F.col("k2")).otherwise(F.col("k3"))
    moved = F.when(F.col("base").isNull(), F.col("iv")).otherwise(F.col("base") + F.call_function("div", value - F.col("lo"), F.col("width")))
    return rows.join(cuts, "iv", "left").withColumn("iv", moved).drop("key", "lo", "width", "base")


def shard_documents(
    docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = (),
    tolerance: float = 0.002, group_share: float = 0.02, first_probes: int = 4096, probes: int = 64, leaf_share: float = 1 / 2048,
) -> DataFrame:
    """Shards of near-equal bytes: (id, size, crc, shard, slot) and the carried columns, named carry_<column>.

    A boundary is in tolerance when it misses its byte target by at most `tolerance` of a mean shard, or when
    the rows on its two sides are neighbours.  An interval is split further while it holds more than `leaf_share`
    of all rows, so no text, id or repeated row, however frequent, gathers in one task.  Slots count from 0
    without gaps in key order.  Equal texts are neighbours in that order, and a group of them is split over shards only
    if it holds more than `group_share` of a mean shard's bytes.  Identical rows are interchangeable between reruns.  Nulls, empty texts and repeated rows are ordinary rows; an empty table
    gives an empty result.
    """
    keyed = keyed_rows(docs, id_col, text_col, overhead, carry)
    spark = docs.sparkSession
    step = 2**63 // first_probes
    rows = keyed.withColumn("iv", F.call_function("div", F.col("k1"), F.lit(step)))
    leaves = sorted(_counts(rows), key=lambda x: x["iv"])
    total, count = sum(x["bytes"] for x in leaves), sum(x["rows"] for x in leaves)
    allowed, most, fresh = tolerance * total / shards, max(1, int(count * leaf_share)), first_probes
    targets = [total * j / shards for j in range(1, shards)]

    def together(parts: list[dict]) -> list[bool]:
        """For each interval whether it belongs to one group of equal texts that stays together."""
        alone = [x["min_k1"] == x["max_k1"] for x in parts]
        held: dict[int, int] = {}
        for x, one in zip(parts, alone):
            if one:
                held[x["min_k1"]] = held.get(x["min_k1"], 0) + x["bytes"]
        return [one and held[x["min_k1"]] <= group_share * total / shards for x, one in zip(parts, alone)]

    while True:
        ends, wanted, at, whole = list(accumulate(x["bytes"] for x in leaves)), set(), 0, together(leaves)
        for t in targets:
            while at < len(ends) and ends[at] < t:
                at += 1
            if at < len(ends) and leaves[at]["rows"] > 1 and not whole[at] and min(ends[at] - t, t - (ends[at] - leaves[at]["bytes"])) > allowed:
                wanted.add(at)
        wanted |= {i for i, x in enumerate(leaves) if x["rows"] > most}
        table = []
        for i in sorted(wanted):
            if cut := _probe(leaves[i], probes):
                table.append(cut | {"base": fresh})
                fresh += probes + 1
        if not table:
            break
        rows = _split(rows, table)
        by_parent: dict[int, list[dict]] = {c["iv"]: [] for c in table}
        owner = {c["base"] + n: c["iv"] for c in table for n in range(probes + 1)}
        fine = rows.where(F.col("iv") >= table[0]["base"])
        for x in sorted(_counts(fine), key=lambda x: x["iv"]):
            by_parent[owner[x["iv"]]].append(x)
        leaves = [y for x in leaves for y in by_parent.get(x["iv"], [x])]

    whole = together(leaves)
    ends, cuts, at = [0, *accumulate(x["bytes"] for x in leaves)], [], 0
    edges = [i for i in range(len(ends)) if not (0 < i < len(leaves) and whole[i] and whole[i - 1] and leaves[i]["min_k1"] == leaves[i - 1]["min_k1"])]
    for t in targets:
        while at + 1 < len(edges) and abs(ends[edges[at + 1]] - t) <= abs(ends[edges[at]] - t):
            at += 1
        cuts.append(edges[at])
    plan, shard, base = [], 0, 0
    for i, x in enumerate(leaves):
        while shard < len(cuts) and cuts[shard] <= i:
            shard, base = shard + 1, 0
        plan.append({"iv": x["iv"], "shard": shard, "first": base})
        base += x["rows"]
    places = F.broadcast(inline_table(spark, plan, "iv long, shard int, first long"))
    within = F.row_number().over(Window.partitionBy("iv").orderBy(*KEYS))
    placed = rows.join(places, "iv").withColumn("slot", F.col("first") + within - 1)
    return placed.select("id", "size", "crc", "shard", "slot", *[c for c in rows.columns if c.startswith("carry_")])
