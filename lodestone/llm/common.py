"""What the corpus operators share: table reading, lineage cuts, small driver-made tables, components."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Texts can be long, so batches are kept well below Spark's 10,000 rows.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most ARROW_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares.

    The folder is spark.checkpoint.dir.  A temporary one is set only where the session names none and all tasks run in
    one process; on a cluster a folder must be named.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoints-"))
    return df.checkpoint(eager=True)


#: Ids, or rows as small, that are broadcast at most.
BROADCAST_ROWS = 500_000


def small_or_shuffled(rows: DataFrame) -> DataFrame:
    """Rows of a few short columns with a broadcast hint if they are few enough; else joins shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def inline_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A DataFrame of driver-made rows whose number has a fixed bound; made by the JVM from one JSON literal."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with a gapless long `rank` from 0 in the given order, by range-sorted partitions; df is materialised."""
    place = materialise(df.orderBy(*order).withColumn("place_", F.monotonically_increasing_id()))
    part, at, offsets = F.shiftright("place_", 33), 0, []
    for r in sorted(place.groupBy(part.cast("int").alias("part")).count().collect()):
        offsets.append({"part_": r.part, "before_": at})
        at += r["count"]
    small = F.broadcast(inline_table(df.sparkSession, offsets, "part_ int, before_ long"))
    joined = place.withColumn("part_", part.cast("int")).join(small, "part_")
    return joined.withColumn("rank", F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))).drop("part_", "place_", "before_")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def training_row(doc_id: Column) -> Column:
    """Labels may be learnt from a row only if crc32 of its id's text leaves a remainder other than 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Share of a sample's characters that one text may hold.
ONE_TEXT = 0.01


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int = 1 << 62) -> DataFrame:
    """Up to `most` labelled training rows (half of each class where there are enough) of up to `chars` characters as (doc_id, text, y).

    The sample is the rows of smallest hash of the id, so reruns agree.  It has a fixed bound, hence the broadcast.
    A document id that occurs in several rows of either table gives one training row; of several texts the one of smallest hash.
    With a bound on characters, texts of more than ONE_TEXT of it are no training rows (they are scored like any other); only lengths are summed, in
    a window of at most `most` short rows.
    """
    lab = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & training_row(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    half = most // 2
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if chars != 1 << 62:
        short = texts.where(F.length("text") <= max(1, int(chars * ONE_TEXT)))
        lab = lab.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
        texts = short
    picked = [lab.where(F.col("y") == v).orderBy(order, "doc_id").limit(half) for v in (0, 1)]
    sample = materialise(picked[0].unionByName(picked[1]))
    texts = texts.withColumn("key", F.struct(F.xxhash64("text"), F.length("text"), F.crc32(F.col("text").cast("binary"))))
    one = texts.select("doc_id", "key").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("key").alias("key"))
    if chars != 1 << 62:
        upto = F.sum(F.col("key.col2")).over(Window.partitionBy(F.lit(0)).orderBy(order, "doc_id"))
        one = one.withColumn("upto", upto).where(F.col("upto") <= chars).drop("upto")
    return texts.join(F.broadcast(materialise(one)), ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "y", "text")


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in edges(a, b); component is the smallest id that can be reached.

    Each round takes the smallest label among a node and its neighbours, then follows labels once more
    (pointer jumping), so chains shrink geometrically.  Every round ends in a reliable checkpoint.
    Self-loops and repeated edges are allowed; no edges give no rows.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("a").alias("b"), F.col("c").alias("nc")), "b").groupBy("a").agg(F.min("nc").alias("nc"))
        hooked = label.join(near, "a").select("a", F.col("c").alias("old"), F.least("c", "nc").alias("c"))
        jump = label.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        after = hooked.join(jump, "c", "left").select("a", "old", F.least("c", F.coalesce("cc", "c")).alias("c"))
        after = materialise(after)
        label = after.select("a", "c")
        if after.where("old <> c").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return label.select(F.col("a").alias("id"), F.col("c").alias("component"))
