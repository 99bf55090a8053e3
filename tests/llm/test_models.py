"""Classifiers by their held-out accuracy and by plain Python."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import quality, toxicity
from lodestone.llm.common import labelled_sample, table

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize(("model", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_documents_are_told_apart(spark, model, label):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    fitted = model.train(docs, labels)
    scored = model.add_scores(docs, fitted, to="score").join(labels, "doc_id").where(f"{label} is not null").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    ones, zeros = ([r.score for r in held if r[label] == v] for v in (1, 0))
    assert len(ones) > 3 and len(zeros) > 3
    pairs = [(a > b) + 0.5 * (a == b) for a in ones for b in zeros]
    assert sum(pairs) / len(pairs) > 0.85, "area under the curve"
    assert all(0 <= r.score <= 1 for r in scored)


@pytest.mark.parametrize(("model", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_and_empty_tables(spark, model, label):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "y " * 9000)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y")
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    fitted = model.train(docs, labels)
    got = model.add_scores(docs.drop("score"), fitted, to="score").collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert model.add_scores(docs.limit(0), fitted, to="other").count() == 0


def test_scores_by_a_dictionary_of_ngrams():
    """Features, ratios and scores against plain Python; no two n-grams of these texts share a number."""
    texts = ["you awful fool", "a kind and gentle word", "awful awful noise", "a gentle fool \U0001f600", "", None, "gentle"] * 6
    y = np.array([1, 0, 1, 0, 0, 0, 0] * 6)

    def number(gram: str) -> int:
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
        return ((h ^ len(gram)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    def grams(text: str | None) -> set[int]:
        text = f" {(text or '').lower()} "
        return {number(text[i : i + n]) for n in toxicity.ORDERS for i in range(len(text) - n + 1)}

    found = [toxicity.features([t or ""]) for t in texts]
    assert [set(f.tolist()) for f in found] == [grams(t) for t in texts]
    model = toxicity.fit(found, y)
    counts = [Counter(g for t, v in zip(texts, y) if v == label for g in grams(t)) for label in (1, 0)]
    ratio = {g: math.log((1 + counts[0][g]) / (2 + y.sum())) - math.log((1 + counts[1][g]) / (2 + (1 - y).sum())) for g in counts[0] | counts[1]}
    for text in [*texts[:7], "awful", "unseen", "a kind fool"]:
        known = [g for g in grams(text) if g in ratio]
        z = sum(float(model.weights[g]) for g in known) / max(math.sqrt(sum(ratio[g] ** 2 for g in known)), 1e-9) + model.intercept
        assert toxicity.score([text or ""], model)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_rules_in_python_give_the_column(spark):
    docs, labels = table(spark, SMALL, "documents").select("doc_id", "text"), table(spark, SMALL, "labels")
    model = quality.train(docs, labels)
    assert model.rules

    def by_hand(text: str | None) -> float:
        stats = dict(zip(quality.STATS, quality.text_stats(text or "")))
        z = model.intercept + sum(w for w, rule in model.rules if all((stats[c.stat] > c.bound) == c.above for c in rule))
        return 1 / (1 + math.exp(-z))

    for r in quality.add_scores(docs, model, to="score").collect():
        assert r.score == pytest.approx(by_hand(r.text), abs=1e-9)


def test_a_sample_is_bounded_and_ties_are_settled(spark):
    docs = spark.createDataFrame([(i, f"text {i} {j} " + "x" * i) for i in range(60) for j in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0)], "doc_id long, toxic int")
    once = labelled_sample(docs, labels, "toxic", 20, 400).collect()
    assert sorted(once) == sorted(labelled_sample(docs.repartition(5), labels.repartition(3), "toxic", 20, 400).collect())
    assert len(once) <= 20 and sum(len(r.text) for r in once) <= 400 and len({r.doc_id for r in once}) == len(once)


def test_held_out_rows_are_never_learnt_from(spark):
    sample = labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic", 10_000)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample.collect())
