"""Document fingerprints from closed syncmers.

A text's tokens are its runs of characters without blanks, long ones in pieces.  Of all windows of five tokens those are anchors whose smallest pair of
neighbouring tokens, by hash, is the first or the last of the window.  Whether a window is an anchor depends on its own tokens alone, so a
passage has the same anchors wherever it stands, and an edit changes only those near it.  At least one of three
successive windows is an anchor, so the distance to the anchor before is 1, 2 or 3.

A fingerprint lists the anchors in their order, each as this distance and 32 bits of its hash: nine hexadecimal digits.
Two texts are alike to the degree that they share anchors at equal distances from the anchors before.

All of this runs as DataFrame expressions.  Each text moves once, to the range of ids that it and its successor belong to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import inline_table, let, materialise

#: Tokens: runs without blanks, cut every 16 characters.
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Tokens of a window, and of the pairs whose order decides.
WINDOW, INNER = 5, 2
#: Ranges of ids: bytes of text that one should hold, bounds on their number, and ids sampled for each to place its ends (balance depends on them, results don't).
RANGE_BYTES, LEAST_RANGES, MOST_RANGES, SAMPLED = 64 << 20, 512, 32_768, 8
#: Stands for a null id in the order: after all others.
NO_ID = 2**63 - 1


def anchors(text: Column) -> Column:
    """array<long> of a text's anchors in order, each distance * 2^32 + hash.

    A text with tokens but without an anchor, which has fewer than eight tokens, has one of all its tokens.  A null text has none.
    """

    def entry(distance: Column, key: Column) -> Column:
        return distance.cast("long") * (1 << 32) + key.bitwiseAND(F.lit(0xFFFFFFFF))

    def of(h, words):
        at = lambda i, n: F.get(h, i + n)
        closed = lambda i: F.least(at(i, 0), at(i, 3)) <= F.least(at(i, 1), at(i, 2))
        places = F.filter(F.sequence(F.lit(0), F.size(words) - WINDOW), closed)
        return let(places, lambda p: F.transform(p, lambda i, j: entry(i - F.coalesce(F.get(p, j - 1), F.lit(-1)), F.xxhash64(at(i, 0), at(i, 2), at(i, 3)))))

    def body(words):
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        none = F.array().cast("array<bigint>")
        several = F.when(n >= WINDOW, let(pairs, lambda h: of(h, words))).otherwise(none)
        return let(several, lambda found: F.when((F.size(found) == 0) & (n > 0), F.array(entry(F.lit(1), F.xxhash64(words)))).otherwise(found))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), body)


def written(anchors_: Column) -> Column:
    """A fingerprint as text: nine digits for each anchor."""
    return F.array_join(F.transform(anchors_, lambda x: F.hex(x)), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the anchors of either text that both have at equal distances, from 0 to 1; 1 for two texts without any."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _truncated(a: int, w: int) -> int:
    return a // w if a >= 0 else -(-a // w)


def _ranges(keys: DataFrame, rows: int, count: int) -> tuple[int, int, int, DataFrame]:
    """The width, first and last of the cells of equal width over ids, and a table (cell, base, cuts) with the cuts between ranges that lie in each: what finds the range of a key."""
    spark = keys.sparkSession
    # About as many keys as are wanted have hashes below a bound, so no more than these leave their tasks.
    share = int(min(1.0, SAMPLED * count / max(rows, 1)) * (1 << 40))
    sample = sorted(tuple(r) for r in keys.select("k1", "k2", "k3").where(F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(1 << 40)) <= share).collect())
    cuts = sorted({sample[i * len(sample) // count] for i in range(1, count)} if sample else [])
    low, high = (cuts[0][0], cuts[-1][0]) if cuts else (0, 0)
    width = (high - low) // (4 * count) + 1
    first, last = _truncated(low, width), _truncated(high, width)
    inside: dict[int, list] = {}
    for c in cuts:
        inside.setdefault(_truncated(c[0], width), []).append(dict(zip("abc", c)))
    table, base = [], 0
    for cell in range(first, last + 1):
        table.append({"cell": cell, "base": base, "cuts": inside.get(cell, [])})
        base += len(inside.get(cell, []))
    return width, first, last, F.broadcast(inline_table(spark, table, "cell long, base int, cuts array<struct<a:long,b:long,c:long>>"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, k3, range, id, text, next_text) of each row, in ranges of ascending ids; the last row's next is the first.  Null texts are empty.

    Rows of one id come by the hash of their text; null ids come last.  Reads docs three times, so its rows must come the same each time, as those of
    files do; where they don't, the job fails.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
    )
    keys = materialise(rows.select("k1", "k2", "k3", F.octet_length("text").alias("bytes")))
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    width, first, last, table = _ranges(keys, n, min(MOST_RANGES, max(LEAST_RANGES, math.ceil(total / RANGE_BYTES))))

    def placed(d: DataFrame) -> DataFrame:
        cell = F.greatest(F.lit(first), F.least(F.lit(last), F.call_function("div", F.col("k1"), F.lit(width).cast("long"))))
        before = F.filter("cuts", lambda c: c <= F.struct(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("k3").alias("c")))
        return d.withColumn("cell", cell).join(table, "cell").withColumn("range", F.col("base") + F.size(before)).drop("cell", "base", "cuts")

    # The first row of each range also goes, as a ghost, to the end of the range before.
    heads = sorted((r.range, *r.head) for r in placed(keys).groupBy("range").agg(F.min(F.struct("k1", "k2", "k3")).alias("head")).collect())
    ghosts = [dict(zip(("k1", "k2", "k3"), h[1:])) | {"to": heads[n - 1][0]} for n, h in enumerate(heads)]
    ghosts = F.broadcast(inline_table(docs.sparkSession, ghosts, "k1 long, k2 long, k3 long, to int"))
    both = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("ghost")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("range"), F.lit(True).alias("ghost")))))
    dealt = placed(rows).join(ghosts, ["k1", "k2", "k3"], "left").withColumn("both", both).drop("range", "to")
    dealt = dealt.select("k1", "k2", "k3", "id", "text", F.inline("both"))
    return dealt.withColumn("next_text", F.lead("text").over(_in_range()))


def _in_range():
    return Window.partitionBy("range").orderBy("ghost", "k1", "k2", "k3")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's text and edited text: (id, n_chars, edited_sha256, anchors, edited_anchors, near_edited, near_next).

    The edited text ends in the start of the next row's text, by ascending id, instead of its own last quarter.  Null and empty texts have no anchors;
    repeated rows are rows of their own, and each is the next of the one before.  An empty table gives no rows.
    """
    d = with_next(docs, id_col=id_col, text_col=text_col)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    d = d.select("range", "ghost", "k1", "k2", "k3", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text")).alias("anchors"), "edited")
    d = d.withColumn("edited_anchors", F.when(~F.col("ghost"), anchors(F.col("edited")))).drop("edited")
    d = d.withColumn("near_edited", likeness(F.col("anchors"), F.col("edited_anchors"))).withColumn("next_anchors", F.lead("anchors").over(_in_range()))
    d = d.where("not ghost").withColumn("next_anchors", F.coalesce("next_anchors", F.raise_error(F.lit("rows changed between reads")).cast("array<bigint>")))
    return d.select("id", "n_chars", "edited_sha256", "anchors", "edited_anchors", "near_edited", likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))
