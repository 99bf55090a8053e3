"""Interaction audit of filters with a packed bitmap index.

Each filter, each label and each part of the corpus is a bit per document.  A partition packs these bits batch by batch, takes the
bits of a part without those of a set of filters (AND-NOT), for each of the sets that a prefix of an order can be, and
counts what is left, and what of it bears each label.  The sums of these counts over all partitions, 32 sets for each part with five filters,
tell what every filter removes at every step of every order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_or_shuffled

#: What separates words, and the limits of the filters.
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABELS = ("good", "toxic")


def repeated_text(rows: DataFrame) -> DataFrame:
    """rows (id, digest, ...) with `repeats`: whether a smaller id has a text of the same digest.

    Digests are counted before rows move.  Those that repeat are broadcast where they are counted few; beyond that rows are joined with them by digest, and Spark
    splits the join at a digest of many rows.  Rows with a null id repeat nothing.
    """
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    joined = rows.join(small_or_shuffled(materialise(firsts.select("digest", "first_id"))), "digest", "left")
    return joined.withColumn("repeats", F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))).drop("first_id")


def filter_bits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, a, b, c, d, e): whether each document fails the five filters.  Null texts and parts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), F.inline(words), text.alias("text"))
    d = d.select(
        "id", "part", "digest", (F.col("n") < LEAST_WORDS).alias("a"), (100 * F.col("kinds") < LEAST_DISTINCT * F.col("n")).alias("b"),
        (100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long")).alias("c"), F.col("text").rlike(MARKS).alias("d"),
    )
    return repeated_text(materialise(d)).withColumnRenamed("repeats", "e").drop("digest")


def popcount(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def prefix_counts(batches: Iterator[pd.DataFrame], filters: tuple[str, ...], labels: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """(part, removed, kept, kept_<label>...) of the documents of a partition: for each set of filters, as bits of `removed`, how many fail none of it."""
    sums: dict[str, np.ndarray] = {}
    sets = 1 << len(filters)
    for batch in batches:
        fails, marked = ([np.packbits(batch[c].to_numpy(bool)) for c in names] for names in (filters, labels))
        which, names = pd.factorize(batch.part)
        for n, name in enumerate(names):
            left = [np.packbits(which == n)]
            count = sums.setdefault(name, np.zeros((sets, 1 + len(labels)), np.int64))
            for s in range(sets):
                if s:
                    last = s.bit_length() - 1
                    left.append(left[s - (1 << last)] & ~fails[last])
                count[s] += [popcount(left[s]), *(popcount(left[s] & m) for m in marked)]
    for name, count in sums.items():
        yield pd.DataFrame({"part": name, "removed": range(sets), "kept": count[:, 0], **{f"kept_{c}": count[:, 1 + i] for i, c in enumerate(labels)}})


def audit(bits: DataFrame, filters: str = "abcde") -> DataFrame:
    """What each filter removes at each step of each order, for each part.

    bits has `part`, a column of booleans for each letter of filters, and those of LABELS.  Returns (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley), orders in capitals.  An empty table gives no rows.
    """
    names = tuple(filters)
    ddl = "part string, removed int, kept long, " + ", ".join(f"kept_{c} long" for c in LABELS)
    counted = bits.select("part", *names, *LABELS).mapInPandas(lambda batches: prefix_counts(batches, names, LABELS), ddl)
    sums = counted.groupBy("part", "removed").agg(*[F.sum(c).alias(c) for c in ("kept", *(f"kept_{c}" for c in LABELS))])
    per_part = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("removed", F.struct("kept", *[f"kept_{c}" for c in LABELS])))).alias("of"))
    every = (1 << len(names)) - 1
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[i] for i in order).upper(), "step": step, "bit": 1 << f, "before": before})
            before |= 1 << f
    # The number of steps is fixed by the number of filters.
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    d = per_part.select("part", "of", F.inline(steps))
    at: dict[str, Column] = {"before": F.col("before"), "after": F.col("before") + F.col("bit"), "none": F.lit(0), "alone": F.col("bit"), "others": F.lit(every) - F.col("bit"), "all": F.lit(every)}
    kept = {k: F.element_at("of", v) for k, v in at.items()}
    removed = kept["before"]["kept"] - kept["after"]["kept"]
    d = d.select(
        "part", "filter_order", "step", "bit", kept["after"]["kept"].alias("kept"), removed.alias("removed"), (kept["none"]["kept"] - kept["alone"]["kept"] - removed).alias("redundant"),
        (kept["others"]["kept"] - kept["all"]["kept"]).alias("unique_fails"), *[(kept["before"][f"kept_{c}"] - kept["after"][f"kept_{c}"]).alias(f"{c}_lost") for c in LABELS],
    )
    return d.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents by lang, with labels (doc_id, quality, toxic); a document that labels name more than once bears what any of them says,
    and one without an id none."""
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    bits = filter_bits(docs).join(marks, "id", "left")
    return audit(bits.withColumns({c: F.coalesce(c, F.lit(False)) for c in LABELS}))
