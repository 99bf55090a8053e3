"""Hard negatives, fingerprints and the filter audit against plain Python, on odd rows too; training samples with long texts, and search over norms that differ."""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
import xxhash
from lodestone.llm import filter_audit, fingerprints, permutation_index, toxicity, vector_file
from lodestone.llm.common import labelled_sample, table
from lodestone.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute_negatives(ids, labels, x, anchors, positives=5, negatives=10):
    q = np.floor(256 * np.asarray(x, np.float64)).astype(np.int64)
    out = []
    for a in np.flatnonzero(anchors):
        s = q @ q[a]
        order = [i for i in np.lexsort((ids, -s)) if i != a]
        for p in [i for i in order if labels[i] == labels[a]][:positives]:
            inside = [i for i in order if labels[i] != labels[a] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]][:negatives]
            out += [(ids[a], ids[p], r, ids[i], s[p], s[i]) for r, i in enumerate(inside, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "copies", "wide"])
def test_hard_negatives_are_those_of_all_pairs(spark, kind, monkeypatch):
    """Clusters; a third of all rows one vector and ties among others; components that differ by far more than there are cells."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 12))
    if kind == "copies":
        x = np.round(x, 1)
        x[:500] = x[0]
    if kind == "wide":
        x = x * rng.lognormal(2, 1.5, size=(1500, 1))
    x, ids, labels = x.astype(np.float32), rng.permutation(1500), rng.integers(0, 4, 1500)
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist(), "label": labels}))
    docs = docs.withColumn("embedding", docs.embedding.cast("array<float>"))
    monkeypatch.setattr(vector_file, "ANCHORS", 20)  # several groups of anchors
    got = found(vector_file.hard_negatives(docs, lambda i: i % 30 == 0))
    assert got == brute_negatives(ids, labels, x, ids % 30 == 0)


def test_the_file_leaves_few_vectors_to_be_scored(spark):
    rng = np.random.default_rng(9)
    q = np.floor(256 * rng.normal(size=(4000, 32)) * 5).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"q": q.tolist()})).selectExpr("cast(q as array<int>) q")
    file = vector_file.fitted_file(rows)
    codes = file.codes(q)
    least, most = file.bounds(q[:50].astype(float), codes)
    exact = 2 * (q[:50] @ q.T)
    assert codes.max() == 255 and (least <= exact).all() and (exact <= most).all()
    anchors = pd.DataFrame({"anchor": range(50), "own_label": "a", "own": list(q[:50])})
    part = pd.DataFrame({"row": range(100, 4100), "label": "a", "code": [c.tobytes() for c in codes]})
    assert len(vector_file.possible_positives(anchors, part, file, 5)) < 0.02 * 50 * 4000


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.5, 0.0], 2), (None, [0.5, 0.0], 2), (4, [0.5, 0.0], None), (5, None, 2), (6, [0.5, None], 2), (7, [NAN, 0.5], 2), (8, [INF, 0.5], 2),
            (9, [0.5, 0.5, 0.5], 2), (10, [], 2), (11, [], 1), (12, [0.4, 3.0], 2), (13, [1.0, 0.0], 2), (100, [0.0, 0.0], 1), (200, [-1.0, 0.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS row", "2 AS q", "3 AS anchor", "4 AS id")
    got = found(vector_file.hard_negatives(d.drop("id"), lambda i: i % 100 == 0))
    near = [(1, 3, 32768), (2, None, 32768), (3, 12, 26112)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    # Of the two rows of id 2 each is a positive; with vector 0 all scores are 0, so any row of another label is in the window.
    want = [(0, 2, r, n, 65536, s) for r, n, s in near] * 2
    zero = [(100, p, r, n, 0, 0) for p in (0, 2, 2, 200) for r, n in enumerate((3, 12, 13, None), 1)]
    assert sorted((r for r in got if r[0] in (0, 100)), key=key) == sorted(want + zero, key=key)
    assert vector_file.hard_negatives(d.drop("id").limit(0), lambda i: i > 0).count() == 0


MASK = 0xFFFFFFFF


def xx(*values) -> int:
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed=seed)
    return seed


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def brute_anchors(text: str) -> list[int]:
    words = re.findall(fingerprints.TOKEN, text)
    pairs = [signed(xx(a, b)) for a, b in zip(words, words[1:])]
    places = [i for i in range(len(words) - 4) if min(pairs[i], pairs[i + 3]) <= min(pairs[i + 1], pairs[i + 2])]
    if not places:
        return [(1 << 32) + (xx(*words) & MASK)] if words else []
    return [((i - before) << 32) + (xx(pairs[i], pairs[i + 2], pairs[i + 3]) & MASK) for before, i in zip([-1, *places], places)]


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def check_fingerprints(got, docs):
    """docs: (id, text) in the order that is asked."""
    want = []
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        a, b = brute_anchors(text), brute_anchors(edited)
        written = ["".join(f"{x:X}" for x in y) for y in (a, b)]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *written, like(a, b), like(a, brute_anchors(after))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def fingerprint_rows(df):
    return [(r.id, r.n_chars, r.edited_sha256, r.f, r.e, r.near_edited, r.near_next) for r in df.select("*", fingerprints.written(df.anchors).alias("f"), fingerprints.written(df.edited_anchors).alias("e")).collect()]


def test_fingerprints_are_those_of_plain_python(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check_fingerprints(fingerprint_rows(fingerprints.fingerprints(docs)), sorted((r.doc_id, r.text or "") for r in docs.collect()))
    rows = QUERIES["op12_closed_syncmers"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.fingerprint for r in rows}) == len({r.text for r in docs.collect()}), "equal texts alone have equal fingerprints"
    assert np.median([r.near_edited for r in rows]) > 0.5 > 0.05 > np.median([r.near_next for r in rows])


def test_fingerprints_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{n}" for n in rng.integers(0, 5000, 30_000))
    rows = [(7, "a b"), (7, "a b"), (7, "c"), (-3, ""), (5, None), (2**62, "é 😀 " * 9), (-(2**62), "x" * 100), (8, long), (9, long[1000:]), (None, "last one of all the words"), (10, " \t\n")]
    for some in (rows, rows[:1], []):
        d = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS `range`", "3 AS ghost", "4 AS anchors", "5 AS id")
        d.repartition(4).write.parquet(str(tmp_path / str(len(some))))
        got = fingerprint_rows(fingerprints.fingerprints(spark.read.parquet(str(tmp_path / str(len(some))))))
        # Rows of one id come by the hash of their text.
        asked = sorted(((i, t or "") for i, t in some), key=lambda r: (r[0] is None, r[0] or 0, signed(xx(r[1]))))
        check_fingerprints(got, asked) if some else None
        assert len(got) == len(some)
    passage = " ".join(f"p{n}" for n in range(60))
    a, b = brute_anchors("some words before it " + passage + " x"), brute_anchors("quite another start of a text here " + passage)
    assert len(set(a) & set(b)) >= 20, "a passage has the same anchors wherever it stands"
    assert all(1 <= x >> 32 <= 3 for x in brute_anchors(long)), "of three windows one is an anchor"


def brute_audit(docs, labels):
    first, marks = {}, {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, quality, toxic in labels:
        if i is None:
            continue
        g, t = marks.get(i, (False, False))
        marks[i] = (g or quality == 1, t or toxic == 1)
    parts: dict[str, list] = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(filter_audit.WORD, text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and first.get(text, i) < i,
        }
        parts.setdefault(lang or "", []).append((fails, marks.get(i, (False, False))))
    out = []
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                steps.append((f, [part, "".join(order), step, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), alone, sum(r[1][0] for r in gone), sum(r[1][1] for r in gone)]))
        out += [(*s, shapley[f]) for f, s in steps]
    return sorted(out)


def test_audit_of_odd_rows(spark):
    long = "Word " * 150 + "other " * 150
    docs = [(1, None, "en"), (2, "", "en"), (3, "", None), (3, "", ""), (4, long, "en"), (5, long, "fr"), (6, long, "fr"), (None, long, "fr"), (7, "A #", "de"), (8, "x y " * 200, "en"), (9, " ".join(map(str, range(300))) + " $", "en")]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (9, None, 1), (6, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "2 AS digest", "3 AS a", "4 AS id")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good")
    got = sorted(tuple(r) for r in filter_audit.audit_documents(d, marks).collect())
    assert got == brute_audit(docs, labels) and len(got) == 600 * 4
    assert filter_audit.audit_documents(d.limit(0), marks).count() == 0


def test_prefix_counts_add_up_over_batches():
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"part": rng.choice(["x", "y", ""], 1000), **{c: rng.random(1000) < 0.3 for c in "abcde"}, **{c: rng.random(1000) < 0.5 for c in filter_audit.LABELS}})
    (whole, some) = (
        pd.concat(filter_audit.prefix_counts(iter(b), tuple("abcde"), filter_audit.LABELS)).sort_values(["part", "removed"]).reset_index(drop=True) for b in ([rows], [rows[:333], rows[333:334], rows[334:]])
    )
    assert whole.equals(some) and len(whole) == 3 * 32
    left = rows[(rows.part == "x") & ~rows.a & ~rows.c]
    r = whole[(whole.part == "x") & (whole.removed == 0b00101)].iloc[0]
    assert (r.kept, r.kept_good, r.kept_toxic) == (len(left), left.good.sum(), left.toxic.sum())


def test_a_long_text_does_not_end_the_sample(spark):
    """A labelled text of more characters than the whole bound leaves the others in the sample; it is scored, and whole."""
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * (1_000_000 if i == 3 else 50) + f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    taken = {r.doc_id for r in labelled_sample(docs, labels, "toxic", 4000, 3_000_000).collect()}
    assert taken == {r.doc_id for r in labelled_sample(docs, labels, "toxic", 4000).collect()} - {3} and len(taken) > 100
    assert sum(len(r.text) for r in labelled_sample(docs, labels, "toxic", 4000, 9000).where("length(text) > 0").collect()) <= 9000
    scores = {r.doc_id: r.toxic_score for r in toxicity.add_scores(docs, toxicity.train(docs, labels)).collect()}
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in scores.items())


def test_labels_of_one_class_reject_nothing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert not toxicity.train(docs, labels).learnt
    assert corpus_pipeline.without_toxic(docs, labels).count() == 2


def test_search_over_norms_that_differ(spark):
    """Clusters of lognormal lengths, and one vector far longer than all: recall, and no band that falls back to few pivots."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(100, 48))[rng.integers(0, 100, 9000)] + 0.4 * rng.normal(size=(9000, 48))
    x *= rng.lognormal(0, 0.4, size=(9000, 1))
    x[17] *= 30
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(9000), "embedding": x.tolist()}))
    got: dict[int, set] = {}
    for r in permutation_index.search(docs, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for n in range(0, 9000, 20):
        s = x @ x[n]
        s[n] = -np.inf
        hits += len(got[n] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 450
    norms = np.linalg.norm(x, axis=1)
    for band in range(12):
        of = np.minimum(np.floor(np.log(norms.max() / norms) / np.log(permutation_index.BAND)), permutation_index.BANDS - 1) == band
        if of.sum() >= 1000:
            index = permutation_index.fitted_index(x[of][:4096], norms[of].max(), of.sum(), 20)
            assert len(index.pivots) >= 50, "pivots of every direction"
            assert index.share < 0.3, "a query ranks a part of the band only"
