"""BagMinHash near-duplicates against a comparison of all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from lodestone.llm import near_dedup as N
from lodestone.llm.common import table


def bag(text: str) -> Counter:
    words = N.words_of(text)
    n = min(N.WORDS, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def classes(texts: dict[int, str]) -> dict[int, int]:
    """Smallest id reachable by pairs of similarity 0.8 or more, all pairs compared."""
    bags, parent = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = bags[a], bags[b]
            if not x or not y:
                same = not x and not y and texts[a] == texts[b]
            elif min(x.total(), y.total()) < 0.8 * max(x.total(), y.total()):
                same = False
            else:
                common = (x & y).total()
                same = common >= 0.8 * (x.total() + y.total() - common)
            if same and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_signatures_estimate_weighted_similarity():
    words = [f"w{i}" for i in range(400)]
    x, y = words * 2, words[:340] * 2 + [f"v{i}" for i in range(60)]
    value = N.signatures([N.shingles(x), N.shingles(y)])
    a, b = bag(" ".join(x)), bag(" ".join(y))
    true = (a & b).total() / (a | b).total()
    assert abs((value[0] == value[1]).mean() - true) < 0.1


def test_all_pairs_of_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == classes({r.doc_id: r.text or "" for r in docs.collect()})


def test_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(160):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"x{i}{at}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert {r.id: r.class_id for r in N.near_duplicates(docs).collect()} == classes(texts)


def test_blocks_give_only_links_that_join(spark):
    import pandas as pd

    texts = [" ".join(f"w{j}" for j in range(60)) + f" t{i}" for i in range(6)]
    words = [N.words_of(t) for t in texts]
    low = (N.signatures([N.shingles(w) for w in words]) & np.uint64(255)).astype(np.uint8)
    rows = pd.DataFrame({"band": 0, "bucket": 1, "i": 0, "j": 0, "own": 0, "id": range(6), "comp": range(6), "low": [x.tobytes() for x in low], "members": [N.multiset_members(w).view(np.int64) for w in words]})
    shared = (low[0].reshape(N.BANDS, N.ROWS) == low[1].reshape(N.BANDS, N.ROWS)).all(1)
    assert len(N.compare_blocks(rows)) <= 5
    assert shared.any()


def test_low_bytes_that_agree_by_chance_make_no_shared_band():
    import pandas as pd

    members, low = N.multiset_members(N.words_of("one two three four five six seven")).view(np.int64), bytes(N.REGISTERS)
    bands = [np.r_[first, 7, np.arange(2, N.BANDS) + 100 * first] for first in (1, 2)]
    rows = pd.DataFrame({"band": 1, "bucket": 7, "i": 0, "j": 0, "own": 0, "id": [1, 2], "comp": [1, 2], "low": [low, low], "bands": bands, "members": [members, members]})
    assert N.compare_blocks(rows).to_numpy().tolist() == [[1, 2]]


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (1, None), (2, ""), (2, ""), (3, None), (4, "same words in here now ok"), (4, "same words in here now ok"), (5, "Same, words in here now OK!")]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS bucket", "3 AS members")
    got = sorted((r.id if r.id is not None else -1, r.class_id, r.kept) for r in N.near_duplicates(docs.drop("id")).collect())
    assert len(got) == len(rows)
    if rows:
        assert got == [(-1, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 4, False)]
        assert N.deduplicated(docs).count() == 3


@pytest.mark.parametrize("limit", [500_000, 0])
def test_rows_that_repeat_an_id_with_other_texts(spark, monkeypatch, limit):
    """Id 9 joins the copies of both of its texts, and a crowd of equal texts is one class, with broadcasts or without."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(N, "HOT", 20)
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "uv")
    rows = [(9, one), (9, two), (4, one + " more"), (11, two + " more"), (12, "alone"), (12, "alone")] + [(i, "equal texts of five words") for i in range(20, 70)]
    got = {r.id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 11: 4, 12: 12} | dict.fromkeys(range(20, 70), 20)


def test_very_long_and_repetitive_texts(spark):
    long = " ".join(f"w{i % 9973}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "a " * 100_000), (4, "a " * 90_000), (5, "a " * 40_000)], "doc_id long, text string")
    got = {r.id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
