"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words.  A document's expected number of copies grows with a power of its size, as far as `most` copies, at a rate
per source with which the expected words meet the target.  Its whole part is allocated as certain copies, and the rest is the inclusion
probability p of one more.  Every document draws u from a hash of its id and text and is ranked by its random odds over its inclusion
odds, (u / (1 - u)) / (p / (1 - p)).  Within a source, documents of like size form a stratum, and the n of lowest rank are taken in each, where n
is fixed: the sums of p over strata, rounded so that no running sum is off by one or more.  As sizes in a stratum are alike, fixed
counts keep the words near the target.  Documents of more than a quarter of the target aren't drawn, since one more or less would miss it: they
get a whole number of copies, the one nearest to the source's mean (the one below where that alone would pass the target).
At last a few documents get a copy more or less where that brings a source nearer to its target.

The n-th rank is found with a histogram of the ranks in each stratum, so only the rows of one histogram bin are ever ordered, and rows that are equal
in everything count as one there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, ranked, small_or_shuffled

#: Fixed values of the mixing contract.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3

#: Expected copies grow as size to this power (0: all documents of a source alike).
POWER = 0.5
#: Bins of a histogram of ranks, and strata in a doubling of size.
BINS, STRATA = 4096, 2
#: Share of the target beyond which a document is too large to be drawn, and documents of a source that may get a copy more or less at last.
LARGE, MOVES = 0.25, 8


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit("tie"), text, doc_id)


def source_key(source: Column) -> Column:
    """A join key in which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, target) from rows (key, source, size).

    Sources by code point, null last, weigh `weights` in turn and share all words.  No target passes `most` times its source: the level at
    which the others share by weight rises until no further source reaches its cap.  Only sums reach the driver.
    """
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    per = ranked(per, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = materialise(per.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    level, before = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        r = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")).first()
        if r.n == before or not r.weight:
            break
        level, before = ((r.total or 0) - (r.caps or 0)) / r.weight, r.n
    target = F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight"))
    return per.select("key", "source_size", target.alias("target"))


def copy_rates(sizes: DataFrame, most: int, power: float) -> DataFrame:
    """(key, rate) from (key, size, n, source_size, target, up), a row for each size of a source: expected copies are min(most, rate * size ** power).

    Large documents count with their whole copies.  Of the others the largest sizes reach `most` first.  The rate is that of the largest size which doesn't, null where all do.  A source has no more sizes than its
    longest document has words, however many documents it has.
    """
    words = F.col("size") * F.col("n")
    certain = F.sum(F.when(large(), words * F.floor(mean_copies(most) + F.when(F.col("up"), 0.5).otherwise(1e-9)))).over(Window.partitionBy("key"))
    sizes = sizes.withColumn("certain", F.coalesce(certain, F.lit(0))).where(~large()).withColumn("target", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)))
    larger = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    capped = F.coalesce(F.sum(words * most).over(larger), F.lit(0))
    free = F.sum(words * importance(F.col("size"), power)).over(others)
    rate = F.when(free > 0, (F.col("target") - capped) / free).otherwise(F.when(F.col("target") <= 0, 0.0))
    fitting = sizes.select("key", "size", rate.alias("rate")).where((F.col("rate") >= 0) & (F.col("rate") * importance(F.col("size"), power) < most))
    return fitting.groupBy("key").agg(F.max_by("rate", "size").alias("rate"))


def large() -> Column:
    return F.col("size") > F.col("target") * LARGE


def mean_copies(most: int) -> Column:
    """Copies of a source's documents if all had alike."""
    return F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)


def importance(size: Column, power: float) -> Column:
    return F.pow(F.greatest(size, F.lit(1)).cast("double"), F.lit(power))


def stratum(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * STRATA).cast("int")


def _uniform(*of: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*of), 11) + 0.5) / float(2**53)


def planned(rows: DataFrame, weights: tuple[int, ...], most: int, power: float, seed: int, close: bool = True) -> DataFrame:
    """Materialised rows(row, source, key, size, u, tie, ...) with source_size, target, expected and copies.

    What a row needs to decide is its source's rate and its stratum's cut, so rows are never matched with one another.
    """
    sizes = materialise(rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    targets = materialise(source_targets(sizes.select("key", "source", (F.col("size") * F.col("n")).alias("size")), weights, most))
    sizes = sizes.drop("source").join(small_or_shuffled(targets), "key")
    rounded = F.sum(F.when(large(), F.col("size") * F.col("n") * F.floor(mean_copies(most) + 0.5)))
    up = sizes.groupBy("key").agg((F.coalesce(rounded, F.lit(0)) <= F.max("target")).alias("up"))
    targets = materialise(targets.join(up, "key"))
    sizes = sizes.join(small_or_shuffled(targets.select("key", "up")), "key")
    rates = materialise(targets.join(copy_rates(sizes, most, power), "key", "left"))
    rates = small_or_shuffled(rates)

    def with_expected(d: DataFrame) -> DataFrame:
        drawn = F.coalesce(F.least(F.col("rate") * importance(F.col("size"), power), F.lit(float(most))), F.lit(float(most)))
        d = d.withColumn("expected", F.when(F.col("source_size") == 0, 0.0).when(large(), mean_copies(most)).otherwise(drawn))
        d = d.withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        d = d.withColumn("round", F.coalesce(large() & F.col("up") & (F.col("p") >= 0.5), F.lit(False)).cast("int")).withColumn("p", F.when(large(), 0.0).otherwise(F.col("p")))
        return d.withColumn("stratum", stratum(F.col("size")))

    # How many of each stratum: running sums of p by size, moved by one random offset for each source and cut to whole numbers.
    upto = F.sum(F.col("n") * F.col("p")).over(Window.partitionBy("key").orderBy("size")) + _uniform(F.col("key"), F.lit(seed))
    each = with_expected(sizes.select("key", "size", "n").join(rates, "key")).withColumn("upto", upto)
    each = each.groupBy("key", "stratum").agg(F.max(F.floor(F.col("upto") + 1e-9)).alias("last"))
    first = F.coalesce(F.lag("last").over(Window.partitionBy("key").orderBy("stratum")), F.lit(0))
    wanted = materialise(each.select("key", "stratum", (F.col("last") - first).alias("wanted")))

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    lot = with_expected(rows.join(rates, "key")).withColumn("q", F.when(F.col("p") > 0, odds))
    lot = lot.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    place = ["key", "stratum"]

    def first_past(counts: DataFrame, *order: str) -> DataFrame:
        """Of rows (key, stratum, ..., m, need), in order, the one with which running sums of m reach need, and the need left at it."""
        run = F.sum("m").over(Window.partitionBy(*place).orderBy(*order))
        found = counts.withColumn("run", run).where((F.col("run") >= F.col("need")) & (F.col("run") - F.col("m") < F.col("need")))
        return materialise(found.withColumn("need", F.col("need") - F.col("run") + F.col("m")).drop("run"))

    bins = lot.where("q is not null").groupBy(*place, "bin").agg(F.count("*").alias("m"))
    at = first_past(bins.join(small_or_shuffled(wanted.withColumnRenamed("wanted", "need")), place).where("need > 0"), "bin")
    at = at.select(*place, F.col("bin").alias("cut_bin"), "need")
    ties = lot.join(small_or_shuffled(at), place).where("bin = cut_bin").groupBy(*place, "q", "tie", "need").agg(F.count("*").alias("m"))
    tied = first_past(ties, "q", "tie")
    cuts = tied.select(*place, F.col("q").alias("cut_q"), F.col("tie").alias("cut_tie"), F.when(F.col("need") < F.col("m"), F.col("need")).alias("need"))
    # Of equal rows as many as are wanted, by their numbers: first the partition of the last one, then its place there.
    some = cuts.where("need is not null")
    if some.isEmpty():
        cuts = cuts.select(*place, "cut_q", "cut_tie", F.lit(2**63 - 1).alias("cut_row"))
    else:
        equal = lot.select(*place, "q", "tie", "row", F.shiftright("row", 33).alias("part")).join(small_or_shuffled(some), place).where("q = cut_q and tie = cut_tie")
        parts = first_past(equal.groupBy(*place, "part", "need").agg(F.count("*").alias("m")), "part").select(*place, F.col("part").alias("cut_part"), F.col("need").alias("nth"))
        nth = F.row_number().over(Window.partitionBy(*place).orderBy("row"))
        last = equal.join(small_or_shuffled(parts), place).where("part = cut_part").withColumn("i", nth).where("i = nth").select(*place, F.col("row").alias("cut_row"))
        cuts = materialise(cuts.drop("need").join(materialise(last), place, "left").withColumn("cut_row", F.coalesce("cut_row", F.lit(2**63 - 1))))
    cuts = small_or_shuffled(cuts)

    before = (F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & ((F.col("tie") < F.col("cut_tie")) | ((F.col("tie") == F.col("cut_tie")) & (F.col("row") <= F.col("cut_row")))))
    lot = lot.join(cuts, place, "left").withColumn("extra", F.coalesce(before.cast("int"), "round"))

    lot = lot.withColumn("copies", F.col("whole") + F.col("extra"))
    out = [*rows.columns, "source_size", "target", "expected"]
    if not close:
        return lot.select(*out, "copies")
    # Moves are found by size alone, one for each source in a round: the size that leaves the least gap if a document of it gets a copy more or less.
    state = materialise(lot.where("size > 0").groupBy("key", "size", "copies").agg(F.count("*").alias("n")))
    gaps = targets.join(state.groupBy("key").agg(F.sum(F.col("size") * F.col("copies") * F.col("n")).alias("words")), "key")
    gaps, moves = materialise(gaps.select("key", (F.col("target") - F.col("words")).alias("gap"))), None
    change = F.when(F.col("gap") > 0, 1).otherwise(-1)
    for _ in range(MOVES):
        miss = F.abs(F.abs("gap") - F.col("size"))
        step = state.join(small_or_shuffled(gaps), "key").where((F.col("n") > 0) & (F.col("copies") + change).between(0, most) & (miss < F.abs("gap")))
        step = step.withColumn("change", change).groupBy("key").agg(F.min(F.struct(miss.alias("miss"), "size", "copies", "change")).alias("to"))
        step = materialise(step.select("key", "to.size", "to.copies", "to.change"))
        if step.isEmpty():
            break
        moves = step if moves is None else moves.unionByName(step)
        words = step.select("key", (F.col("size") * F.col("change")).alias("words"))
        gaps = materialise(gaps.join(words, "key").select("key", (F.col("gap") - F.col("words")).alias("gap")))
        # A document that has moved doesn't move again.
        state = materialise(state.unionByName(step.select("key", "size", "copies", F.lit(-1).cast("long").alias("n"))).groupBy("key", "size", "copies").agg(F.sum("n").alias("n")))
    if moves is None:
        return lot.select(*out, "copies")
    # Equal sizes may be asked to move both ways, so the documents of one size and number of copies are numbered, and so are its moves.
    place, numbered = ["key", "size", "copies"], Window.partitionBy("key", "size", "copies")
    moves = materialise(moves.withColumn("nth", F.row_number().over(numbered.orderBy("change"))))
    one = lot.select(*place, "tie", "row").join(small_or_shuffled(moves.select(*place).distinct()), place)
    one = one.withColumn("nth", F.row_number().over(numbered.orderBy("tie", "row"))).where(F.col("nth") <= MOVES)
    one = materialise(one.join(moves, [*place, "nth"]).select("row", "change"))
    lot = lot.join(small_or_shuffled(one), "row", "left")
    return lot.select(*out, (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, **carry: Column) -> DataFrame:
    text = F.col(text_col)
    return materialise(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), words(text).alias("size"),
            _uniform(F.col(id_col), text, F.lit(seed)).alias("u"), identity(F.col(id_col), text).alias("tie"), F.monotonically_increasing_id().alias("row"),
            *[c.alias(name) for name, c in carry.items()],
        )
    )


def mix_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, power: float = POWER, close: bool = True,
) -> DataFrame:
    """How often the mix takes each document: (id, source, size, source_size, target, expected, copies).

    Null texts and texts without words have size 0 (and the chance of a text of one word), and null is a source like any other.  Reruns agree, since
    ranks come from hashes of the id and text; identical rows are interchangeable.  A source without words takes nothing.  An empty table gives no rows.
    Without `close` the Pareto sample stays as it is drawn, with no copy more or less for the sake of the target.
    """
    mix = planned(_rows(docs, id_col, text_col, source_col, seed), weights, most, power, seed, close)
    return mix.select("id", "source", "size", "source_size", "target", "expected", "copies")


def mixed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, power: float = POWER,
) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its own columns.  The rows are materialised once."""
    mix = planned(_rows(docs, id_col, text_col, source_col, seed, whole_row=F.struct(*[F.col(f"`{c}`") for c in docs.columns])), weights, most, power, seed)
    times = fresh(docs, "mix_copy")
    return mix.where("copies > 0").select("whole_row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(times)).drop(times)
