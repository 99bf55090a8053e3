"""Secret scans with a trigram inverted index.

Each rule is a regular expression.  From its syntax follows a Boolean query over trigrams of the lower-cased
text, an OR of ANDs, which every matching text fulfils.  An inverted index lists, for each trigram that occurs
in such a query, the texts that hold it; intersecting the lists gives a rule's candidates, and only those are
searched.  Rules without mandatory trigrams search every text.  Equal texts share one entry of the index, and
since candidates are verified on the row's own text, a collision of hashes can only add work.

All of this runs as DataFrame expressions.
"""

from __future__ import annotations

import re._parser as syntax
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, inline_table, let


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length decides, and the least length at which a match counts.
    group: int = 0
    least: int = 1


#: The three base rules, in the order that ranks spans of equal start.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules that the trigram index adds at the price of its candidates.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

#: Alternatives followed while reading a pattern, and members of a character class that are spelt out.
MOST_ALTERNATIVES, MOST_MEMBERS = 64, 6


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The OR of ANDs of lower-case trigrams that any match of pattern holds; an empty list if there is none.

    A pattern is read as alternatives of literal runs; None marks a place where anything may stand.
    """

    def read(items) -> list[tuple]:
        alternatives: list[tuple] = [()]
        for op, arg in items:
            more = one(str(op), arg)
            if len(alternatives) * len(more) > MOST_ALTERNATIVES:
                more = [(None,)]
            alternatives = [a + b for a, b in product(alternatives, more)]
        return alternatives

    def one(op: str, arg) -> list[tuple]:
        if op == "LITERAL":
            return [(chr(arg).lower(),)]
        if op == "SUBPATTERN":
            return read(arg[-1])
        if op == "BRANCH":
            return [x for branch in arg[1] for x in read(branch)]
        if op == "IN" and len(arg) <= MOST_MEMBERS and all(str(kind) == "LITERAL" for kind, _ in arg):
            return [(chr(c).lower(),) for _, c in arg]
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            if (least, most) == (0, 1):
                return [(), *read(inner)]
            return [x * least + (None,) * (most != least) for x in read(inner)] if least and least <= 8 else [(None,)]
        return [(None,)]

    clauses = set()
    for alternative in read(syntax.parse(pattern)):
        runs = "".join("\0" if x is None else x for x in alternative).split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return []
        clauses.add(grams)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index (gram, text_key), each pair once, over the trigrams that rules ask for."""
    lowered = F.lower("text")
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return texts.select("text_key", lowered.alias("low")).select("text_key", F.explode(held).alias("gram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, kinds): the rules whose trigram query each text fulfils.  Rules without a query aren't listed."""
    clauses = [(r.kind, n, g) for r in rules for n, g in enumerate(trigram_query(r.pattern))]
    wanted = [{"kind": k, "clause": n, "gram": g, "needs": len(gs)} for k, n, gs in clauses for g in sorted(gs)]
    asked = F.broadcast(inline_table(texts.sparkSession, wanted, "kind string, clause int, gram string, needs int"))
    index = postings(texts, sorted({x["gram"] for x in wanted}))
    met = index.join(asked, "gram").groupBy("text_key", "kind", "clause").agg((F.count("*") == F.first("needs")).alias("all"))
    return met.where("all").groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one.  Sums of 64 elements each keep long arrays from costing their square."""
    block = 64

    def total(xs):
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def body(xs):
        n = F.size(xs)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, block)))
        return let(
            F.transform(blocks, lambda x: x),
            lambda bs: let(
                F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda b: total(F.slice(bs, F.lit(1), b))),
                lambda firsts: F.transform(
                    F.sequence(F.lit(0), n - 1),
                    lambda i: F.get(firsts, F.floor(i / block).cast("int")) + total(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block)),
                ),
            ),
        )

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, body))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end>> of a rule's leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches and the matches themselves give, by their lengths, all positions.
    """
    rx = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    decisive = F.regexp_extract_all(text, rx, F.lit(rule.group))

    def spans(m):
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))
        ends = F.zip_with(_running(steps), steps, lambda a, s: a + s)
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), F.lit(rank).alias("rank"), e.alias("end")))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    every = let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))
    if rule.group == 0 and rule.least <= 1:
        return every
    return F.transform(
        F.filter(F.arrays_zip(every.alias("span"), decisive.alias("part")), lambda z: F.length(z["part"]) >= rule.least), lambda z: z["span"]
    )


def scan(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column secret_spans: array<struct<start:int, rank:int, end:int>> in order of start, then rule; a column of that name is replaced.

    Null and empty texts have no spans.  Repeated rows and equal texts each get their own spans.  Only rows of
    texts that are some rule's candidates are joined to them, by the hash of the text: a sort-merge join, in which
    Spark splits a text that many rows share.
    """
    key, kinds = fresh(docs, "secret_key"), fresh(docs, "secret_kinds")
    keyed = docs.withColumn(key, text_key(F.coalesce(F.col(text_col), F.lit(""))))
    texts = docs.select(text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = candidates(texts, rules).select(F.col("text_key").alias(key), F.col("kinds").alias(kinds))
    joined = keyed.join(hits, key, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        asked = F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), rule.kind) if trigram_query(rule.pattern) else F.rlike(text, F.lit(rule.pattern))
        parts.append(F.when(asked, rule_spans(text, rule, rank)).otherwise(none))
    return joined.withColumn("secret_spans", F.sort_array(F.concat(*parts))).drop(key, kinds)


def span_digest(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by [SECRET]; overlapping spans become one.  Texts without secrets stay as they are, null too."""
    found = scan(docs, text_col=text_col, rules=rules)
    text = F.col(text_col)

    def merge(acc, s):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), longer).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        )

    def cut(ms):
        n = F.size(ms)
        tail = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.concat(F.lit("[SECRET]"), F.substring(text, F.get(ms, i)["end"] + 1, F.coalesce(F.get(ms, i + 1)["start"], F.length(text)) - F.get(ms, i)["end"])),
        )
        return F.concat(F.substring(text, F.lit(1), F.get(ms, F.lit(0))["start"]), F.array_join(tail, ""))

    merged = F.aggregate("secret_spans", F.array().cast("array<struct<start:int,end:int>>"), merge)
    return found.withColumn(text_col, F.when(F.size("secret_spans") > 0, let(merged, cut)).otherwise(text)).drop("secret_spans")
