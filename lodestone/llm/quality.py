"""Quality: a sparse ensemble of rules.

A random forest over statistics of texts proposes rules: each path from a root to a node is a conjunction of
threshold conditions.  Logistic regression with an L1 penalty weighs the rules' indicators and keeps few of them.
The kept rules compile to one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, labelled_sample, materialise, small_batches

#: The bound on labelled rows that the forest and the weights are fitted on.
TRAINING_ROWS = 12_000
TREES, DEPTH, PENALTY = 24, 4, 0.002

STATS = (
    "log_chars", "mean_word", "longest_word", "upper", "digits", "symbols", "spaces", "non_ascii", "sentence_ends", "commas",
    "unique_words", "top_word", "repeated_neighbours", "unique_lines", "words_per_line", "odd_words",
)

_CLASS = np.zeros((6, 256), bool)
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*!@^~|<>=_+{}[]\\/", b" \t\r\n", b".!?", b",;:")):
    _CLASS[_n, list(_chars)] = True


def text_stats(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATS; all 0 for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * len(STATS)
    seen = np.bincount(raw, minlength=256)
    upper, digits, symbols, spaces, ends, commas = (seen[c].sum() / len(raw) for c in _CLASS)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = [len(w) for w in words]
    same = sum(map(str.__eq__, words, words[1:]))
    odd = sum(c for w, c in counts.items() if not w[-1].isalpha() and w[-1] not in ".,;:") / n
    return [
        float(np.log1p(len(text))), sum(lengths) / n, float(max(lengths, default=0)), upper, digits, symbols, spaces, seen[128:].sum() / len(raw), ends, commas,
        len(counts) / n, max(counts.values(), default=0) / n, same / n, len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), odd,
    ]


def add_stats(docs: DataFrame, *, text_col: str = "text", to: str = "text_stats") -> DataFrame:
    """docs with a struct of the statistics.  A null text counts as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_stats(t) for t in texts.fillna("")], columns=list(STATS), dtype=float)

    return docs.withColumn(to, stats(F.col(text_col)))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    bound: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.stat}")
        return value > self.bound if self.above else value <= self.bound


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self, stats: str = "text_stats") -> Column:
        """The score as a column expression over the statistics."""
        terms = [F.when(reduce(and_, (c.column(stats) for c in rule)), w).otherwise(0.0) for w, rule in self.rules]
        return 1 / (1 + F.exp(-reduce(add, terms, F.lit(self.intercept))))


def tree_rules(forest) -> list[tuple[Condition, ...]]:
    """Every distinct path from a root to a node below it, as a conjunction with one bound per statistic and side."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found[tuple(Condition(s, up, b) for (s, up), b in sorted(path.items()))] = None
        if node.getClass().getSimpleName() == "LeafNode":
            return
        split = node.split()
        stat, bound = STATS[split.featureIndex()], split.threshold()
        low, high = (stat, False), (stat, True)
        walk(node.leftChild(), path | {low: min(bound, path.get(low, bound))})
        walk(node.rightChild(), path | {high: max(bound, path.get(high, bound))})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> RuleModel:
    """Learns from at most `rows` labelled documents outside the held-out fifth.

    With labels of one class only, or none, every text gets that class's score (0.5 without labels).
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    sample = add_stats(labelled_sample(docs, labels, label, rows)).select(F.col("y").cast("double").alias("y"), "text_stats")
    sample = materialise(sample)
    classes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(classes) < 2:
        return RuleModel({0.0: -6.0, 1.0: 6.0}.get(next(iter(classes), None), 0.0), ())
    flat = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(sample.select("y", "text_stats.*"))
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=4, seed=42).fit(flat)
    rules = tree_rules(forest)
    indicators = F.array(*[reduce(and_, (c.column("text_stats") for c in rule)).cast("double") for rule in rules])
    lasso = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60)
    fitted = lasso.fit(materialise(sample.select("y", array_to_vector(indicators).alias("x"))))
    kept = tuple((float(w), rule) for w, rule in zip(fitted.coefficients.toArray(), rules, strict=True) if abs(w) > 1e-6)
    return RuleModel(float(fitted.intercept), kept)


def add_scores(docs: DataFrame, model: RuleModel, *, text_col: str = "text", to: str = "quality_score") -> DataFrame:
    """docs with a double column `to` (replaced where there is one); null and empty texts score by statistics of 0."""
    stats = fresh(docs, "quality_stats")
    return add_stats(docs, text_col=text_col, to=stats).withColumn(to, model.column(stats)).drop(stats)
