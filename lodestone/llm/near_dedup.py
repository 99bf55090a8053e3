"""Near-duplicate texts by BagMinHash.

A text is the multiset of its five-word shingles; two texts are near-duplicates if their weighted Jaccard similarity,
the sum of smaller counts over the sum of larger counts, is 0.8 or more.

Signatures: a shingle's counts are cut into dyadic levels, [0, 1), [1, 2), [2, 4), [4, 8) and so on.  In each level a
Poisson process, seeded by shingle and level, gives points in time; a point has a place in the level and a register.
A text sees the points whose place lies below its count, and each register keeps its first point.  Two texts agree
in a register with probability equal to their similarity.  A shingle stops once its time passes the last of the
registers' first times, so most give one or two points.

Search: bands of registers make buckets.  Every member of a bucket is compared with the bucket's smallest id.
Texts that these links leave in different components but in one bucket are then compared in blocks by their
registers, and what comes close on the full multisets; a block gives only the links that join components.  All
links are verified on the full multisets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, small_batches, small_or_shuffled

#: Words of a shingle and least similarity.
WORDS, THRESHOLD = 5, 0.8
#: Registers of a band and bands: a pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^7)^36 > 0.9997.
ROWS, BANDS = 7, 36
REGISTERS = ROWS * BANDS
#: Pairs are compared exactly if their registers agree up to four standard errors below the threshold, which 1 pair of 30,000 at the threshold misses.
CLOSE = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / REGISTERS)
#: Rows of a digest that count as many; texts and shingles of a block; rows of a Python call; shingles handled at a time.
HOT, BLOCK, BLOCK_SHINGLES, SLOT, PIECE = 1000, 512, 1 << 22, 4096, 1 << 20

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
#: Odd constants of the hash (golden ratio and the splitmix64 finaliser).
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_FACTORS = [_U(2 * 0x5851F42D4C957F2D * i + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1) for i in range(WORDS)]


def _step(n: int) -> np.uint64:
    return _U(n * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of all shingles, repeats included; a text of one to four words is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _FACTORS[i]
    return mix(out)


def multiset_members(words: list[str]) -> np.ndarray:
    """The multiset as a set: one hash for each shingle and occurrence, so overlaps of sets are overlaps of multisets."""
    s = np.sort(shingles(words))
    if not len(s):
        return s
    start = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), np.arange(len(s)), 0))
    return mix(s + (np.arange(len(s)) - start).astype(np.uint64) * _GOLD)


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """BagMinHash registers of multisets of shingle hashes: the hash of each register's first point (0 without any)."""
    first = np.full((len(bags), REGISTERS), np.inf)
    value = np.zeros((len(bags), REGISTERS), np.uint64)
    group, size = [], 0
    for d, bag in enumerate(bags):
        elements, counts = np.unique(bag, return_counts=True)
        for at in range(0, len(elements), PIECE):
            element = elements[at : at + PIECE]
            group.append((np.full(len(element), d), element, counts[at : at + PIECE]))
            size += len(element)
            if size >= PIECE:
                _add_points(group, first, value)
                group, size = [], 0
    if group:
        _add_points(group, first, value)
    return value


def _add_points(group: list, first: np.ndarray, value: np.ndarray) -> None:
    doc, element, count = (np.concatenate(x) for x in zip(*group))
    count = count.astype(np.int64)
    seeds, docs, counts, lows, spans, level = [mix(element)], [doc], [count], [np.zeros(len(doc), np.int64)], [np.ones(len(doc))], 1
    while (more := count > (low := 1 << (level - 1))).any():
        seeds.append(mix(element[more] + _step(level)))
        docs.append(doc[more])
        counts.append(count[more])
        lows.append(np.full(more.sum(), low))
        spans.append(np.full(more.sum(), float(low)))
        level += 1
    seed, doc, count, low, span = (np.concatenate(x) for x in (seeds, docs, counts, lows, spans))
    time, t = np.zeros(len(seed)), 0
    while len(seed):
        t += 1
        r = mix(seed + _step(t))
        time = time - np.log1p(-((r >> _U(11)).astype(np.float64) / 2.0**53)) / span
        point = mix(r ^ _M2)
        place = low + ((point & _U(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * span).astype(np.int64)
        cell = doc * REGISTERS + ((point >> _U(32)) % _U(REGISTERS)).astype(np.int64)
        seen = np.flatnonzero((place < count) & (time < first.ravel()[cell]))
        np.minimum.at(first.reshape(-1), cell[seen], time[seen])
        won = seen[time[seen] == first.ravel()[cell[seen]]]
        value.reshape(-1)[cell[won]] = point[won]
        if t < 6 or t % 6 == 0:
            alive = np.unique(doc)
            last = np.zeros(len(first))
            last[alive] = first[alive].max(1)
            on = time < last[doc]
            seed, doc, count, low, span, time = (x[on] for x in (seed, doc, count, low, span, time))


def digest(words: list[str], text: str) -> bytes:
    """What texts of equal words share; of texts without words, equal texts."""
    return hashlib.md5(" ".join(words).encode() if words else b"\0" + text.encode("utf-8", "surrogatepass")).digest()


def sketch(texts: list[str]) -> tuple[list[bytes], list, list]:
    """For each text: a digest that equal word sequences share, its band hashes, and one byte of each register (None without words)."""
    words = [words_of(t) for t in texts]
    value = signatures([shingles(w) for w in words])
    factors = np.array([_FACTORS[i % WORDS] + _U(2 * i) for i in range(ROWS)], np.uint64)
    bands = mix((value.reshape(len(texts), BANDS, ROWS) * factors).sum(2) + np.arange(BANDS, dtype=np.uint64) * _GOLD)
    digests = list(map(digest, words, texts))
    low = (value & _U(255)).astype(np.uint8)
    return digests, [b.view(np.int64) if w else None for b, w in zip(bands, words)], [x.tobytes() if w else None for x, w in zip(low, words)]


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                digests, bands, low = sketch(part.text.fillna("").tolist())
                yield pd.DataFrame({"id": part.id.to_numpy(), "digest": digests, "bands": bands, "low": low})

    return docs.mapInPandas(run, "id long, digest binary, bands array<long>, low binary")


def _members(texts: DataFrame) -> DataFrame:
    """(id, members) of rows (id, digest, text), once per id; rows whose text has another digest are left out."""

    @F.pandas_udf("array<long>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            words = map(words_of, texts)
            yield pd.Series([multiset_members(w).view(np.int64) if digest(w, t) == d else None for w, t, d in zip(words, texts, wanted)], dtype=object)

    # Not deterministic for the optimiser, which would else run it before a join, and again for the filter.
    got = texts.select("id", found.asNondeterministic()("text", "digest").alias("members"))
    return got.where("members is not null").dropDuplicates(["id"])


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(id, digest) with the class of their digest, from classes(digest, n, class), null where there is none.

    Where these are too many to broadcast, digests of many rows, of which there are few, are still joined apart from the rest.
    """
    small = small_or_shuffled(classes)
    if small is not classes:
        return rows.join(small.select("digest", "class"), "digest", "left")
    hot = small_or_shuffled(materialise(classes.where(F.col("n") > HOT).select("digest", "class")))
    rest = classes.where(F.col("n") <= HOT).select("digest", "class")
    return rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest", "left"))


def verified(pairs: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    both = pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(members.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    common = F.size(F.array_intersect("ma", "mb"))
    return both.where(common >= threshold * (F.size("ma") + F.size("mb") - common) - 1e-9).select("a", "b")


def compare_blocks(slot: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links between different components in a block, as few as join them: registers agree closely, multisets overlap enough.

    A pair that shares several bands (equal hashes, where the rows carry them) is compared in the first of them only, and
    not at all once other links join it.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    found: list[tuple[int, int]] = []
    for (band, _, i, j), part in slot.groupby(["band", "bucket", "i", "j"], sort=False):
        one, two = (part, part) if i == j else (part[part.own == i], part[part.own == j])
        if not len(one) or not len(two):
            continue
        x, y = (np.frombuffer(b"".join(p.low), np.uint8).reshape(len(p), BANDS, ROWS) for p in (one, two))
        bands = [np.stack(p.bands.to_numpy()) for p in (one, two)] if "bands" in part else None
        ids, comps, members = two.id.tolist(), two.comp.tolist(), two.members.tolist()
        for r, (a, comp, own) in enumerate(zip(one.id.tolist(), one.comp.tolist(), one.members)):
            near = np.flatnonzero((x[r] == y).sum((1, 2)) >= CLOSE * REGISTERS)
            near = near[near > r] if i == j else near
            if bands is not None:
                near = near[(bands[0][r] == bands[1][near]).argmax(1) == band]
            near = [c for c in near.tolist() if root(comps[c]) != root(comp)]
            if not near:
                continue
            own, sizes = np.sort(own), np.array([len(members[c]) for c in near])
            every = np.concatenate([members[c] for c in near])
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            common = np.add.reduceat((own[at] == every).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
            for c in np.flatnonzero(common >= threshold * (len(own) + sizes - common) - 1e-9).tolist():
                u, v = root(comp), root(comps[near[c]])
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    found.append((min(a, ids[near[c]]), max(a, ids[near[c]])))
    return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: (id, class_id, kept).  class_id is the smallest id of its class, and that document is kept.

    Words are runs of letters and digits in lower case, so texts that differ in case, spacing or punctuation only are
    equal.  Texts without words (null counts as empty) are near-duplicates of equal texts only.  Rows that repeat an id are one
    document, near whatever one of its texts is near.  Rows with a null id are in no class (class_id null) and kept.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = materialise(_sketches(plain.where("id is not null")))
    # From here to the last step an id is the number of a digest, so that equal texts are one, however many they are.
    reps = sketches.where("bands is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    reps = materialise(reps.withColumn("id", F.monotonically_increasing_id()))
    names, reps = reps.select("id", "rep", "digest"), reps.select("id", "bands", "low")

    place = ["band", "bucket"]
    banded = reps.select("id", F.posexplode("bands").alias(*place))
    buckets = materialise(banded.groupBy(place).agg(F.min("id").alias("pivot"), F.count("*").alias("m")).where("m > 1").select(*place, "pivot"))
    crowd = materialise(banded.join(buckets, place))
    wanted = materialise(crowd.select("id").distinct().join(names, "id"))
    texts = plain.withColumnRenamed("id", "rep").join(small_or_shuffled(wanted), "rep")
    members = materialise(_members(texts))

    low = reps.select("id", "low")
    star = crowd.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), REGISTERS) for s in (a, b))
        return pd.Series((x == y).sum(1) >= CLOSE * REGISTERS)

    links = materialise(verified(star.where(close("la", "lb")).select("a", "b"), members, threshold))
    component = connected_components(links)

    named = crowd.join(component, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    others = F.when(F.col("id") != F.col("pivot"), F.col("comp"))
    split = named.groupBy(place).agg(F.min(others).alias("lo"), F.max(others).alias("hi")).where("lo <> hi").select(place)
    left = materialise(named.join(split, place, "left_semi").select(*place, "id", "comp"))
    weight = left.join(members.select("id", F.size("members").alias("w")), "id").groupBy(place).agg(F.count("*").alias("m"), F.sum("w").alias("w"))
    weight = materialise(weight.withColumn("nb", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int")))
    load = weight.agg(F.sum(F.col("m") * F.col("nb")).alias("m"), F.sum(F.col("w") * F.col("nb")).alias("w")).first()
    slots = max(1, math.ceil(max((load.m or 0) / SLOT, (load.w or 0) / BLOCK_SHINGLES)))
    left = left.join(weight.select(*place, "nb"), place).join(reps, "id").join(members, "id")
    left = left.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = left.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    left = left.withColumn("slot", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(slots))).select("slot", *place, "i", "j", "own", "id", "comp", "low", "bands", "members")
    links = links.unionByName(left.groupBy("slot").applyInPandas(lambda s: compare_blocks(s, threshold), "a long, b long"))
    rep = names.select("id", "rep")
    pairs = links.join(rep.toDF("a", "x"), "a").join(rep.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # Rows that repeat an id with different texts hold these together.
    rows, classes = sketches.select("id", "digest"), materialise(sketches.groupBy("digest").agg(F.min("id").alias("class"), F.count("*").alias("n")))
    twice = materialise(rows.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y").select("id"))
    if not twice.isEmpty():
        held = rows.join(small_or_shuffled(twice), "id").distinct().join(classes, "digest").select("id", "class")
        pairs = pairs.unionByName(held.join(held.groupBy("id").agg(F.min("class").alias("a")), "id").select("a", F.col("class").alias("b")))
    component = connected_components(pairs)
    classes = classes.join(component.withColumnRenamed("id", "class"), "class", "left").select("digest", "n", "class", F.coalesce("component", "class").alias("to"))
    classes = materialise(classes.where("n > 1 or to <> class").select("digest", "n", F.col("to").alias("class")))
    out = with_class(rows, classes).select("id", F.coalesce("class", "id").alias("class_id"))
    out = out.unionByName(plain.where("id is null").select("id", F.lit(None).cast("long").alias("class_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class.  Of rows that repeat an id, one stays; rows with a null id all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    gone = materialise(found.where(~F.col("kept")).select(F.col("id").alias(id_col)).distinct())
    kept = docs.join(small_or_shuffled(gone), id_col, "left_anti")
    repeated = materialise(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if repeated.isEmpty():
        return kept
    many = small_or_shuffled(repeated)
    return kept.join(many, id_col, "left_anti").unionByName(kept.join(many, id_col, "left_semi").dropDuplicates([id_col]))
