"""Search and near-duplicates of vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from lodestone.llm import multi_index, permutation_index
from lodestone.llm.common import table

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.01]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.1])]


def vectors(docs):
    rows = docs.where("embedding is not null").collect()
    fine = [(r.vec_id, r.embedding) for r in rows if all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    return np.array(sorted(i for i, _ in fine)), np.array([v for _, v in sorted(fine)], np.float64)


def clustered(rng, n):
    """Vectors of differing lengths around 40 directions, half of them in three large clusters, and others everywhere."""
    centre = multi_index.normalised(rng.normal(size=(40, 32)))
    home = np.where(rng.random(n) < 0.5, rng.integers(0, 3, n), rng.integers(0, 40, n))
    x = np.where((rng.random(n) < 0.8)[:, None], centre[home], 0) + 0.15 * rng.normal(size=(n, 32))
    return x * rng.lognormal(0, 0.3, size=(n, 1))


@pytest.mark.parametrize("source", ["sf0.01", "sf0.1", "clustered"])
def test_search_finds_nine_tenths(spark, source):
    if source == "clustered":
        x = clustered(np.random.default_rng(3), 12_000)
        ids = np.arange(len(x))
        docs = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    else:
        docs = table(spark, f"/root/testdata/{source}", "embeddings")
        ids, x = vectors(docs)
    found: dict[int, list] = {}
    for r in permutation_index.search(docs, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        score = x @ x[n]
        others = np.flatnonzero(np.arange(len(ids)) != n)
        best = others[np.lexsort((ids[others], -score[others]))[:20]]
        got = found[ids[n]]
        assert len(got) == 20 and all(abs(s - score[np.searchsorted(ids, i)]) < 1e-9 for i, s in got)
        hits, total = hits + len({i for i, _ in got} & set(ids[best].tolist())), total + 20
    assert hits >= 0.9 * total


def test_search_of_odd_rows(spark):
    d = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS row")
    got = permutation_index.search(d, lambda i: i > 0).collect()
    assert {r.query_id for r in got} == {7, 8, 9, 10}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 9), key=lambda r: r["rank"])] == [8, 7, 7, None]
    assert [r.vec_id for r in got if r.query_id == 10] == [10, 10], "vectors of another length"
    assert permutation_index.search(d.limit(0), lambda i: i > 0).count() == 0


def brute_components(ids, x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            return linked.sum(1), label
        label = new


def test_links_and_components(spark):
    ids, x = vectors(table(spark, SF, "embeddings"))
    links, label = brute_components(ids, x)
    got = {r.id: r for r in multi_index.near_duplicates(table(spark, SF, "embeddings")).collect()}
    found = sum(got[i].n_links for i in ids.tolist())
    assert all(got[i].n_links <= n for i, n in zip(ids.tolist(), links.tolist())), "no link below the threshold"
    assert found >= 0.9 * links.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids.tolist(), label.tolist())]) >= 0.9
    assert all(r.kept == (r.id == r.component_id) for r in got.values())


def turned(rng, x, cosines):
    """A partner of each row of x at each cosine."""
    z = rng.normal(size=x.shape)
    z = multi_index.normalised(z - (z * x).sum(1, keepdims=True) * x)
    c = np.asarray(cosines)[:, None]
    return c * x + np.sqrt(1 - c**2) * z


def test_planted_links_and_large_groups(spark):
    """Pairs at cosines from 0.9 to 1, a group of 400 equal vectors and one of 400 near ones, among 20,000."""
    rng = np.random.default_rng(17)
    base = multi_index.normalised(rng.normal(size=(18_000, 64)))
    pairs = turned(rng, base[:1200], np.linspace(0.9001, 0.999, 1200))
    near = multi_index.normalised(base[5000] + 0.02 * rng.normal(size=(400, 64)))
    x = np.concatenate([base, pairs, np.repeat(base[6000:6001], 400, 0), near])
    ids = rng.permutation(len(x))
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    got = {r.id: r for r in multi_index.near_duplicates(docs).collect()}
    by = np.argsort(ids)
    links, label = brute_components(np.arange(len(x)), x[by])
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= links).all(), "no link below the threshold"
    assert n.sum() >= 0.95 * links.sum()
    low = ids[18_000:18_120]  # cosines of 0.900 to 0.91
    assert n[low].sum() >= 0.9 * links[low].sum()
    assert np.mean([got[i].component_id == c for i, c in enumerate(label.tolist())]) >= 0.99


@pytest.mark.parametrize("kind", ["low rank", "clusters"])
def test_links_of_tables_that_fill_little_of_their_space(spark, kind):
    """6,000 vectors of 64 dimensions near a plane of 6, or in 60 clusters whose members turn in a few directions of their own."""
    rng = np.random.default_rng(23)
    if kind == "low rank":
        x = rng.normal(size=(6000, 6)) @ rng.normal(size=(6, 64)) + 0.05 * rng.normal(size=(6000, 64))
    else:
        centre, ways = rng.normal(size=(60, 64)), rng.normal(size=(60, 3, 64))
        home = rng.integers(0, 60, 6000)
        x = centre[home] + 0.3 * np.einsum("nk,nkd->nd", rng.normal(size=(6000, 3)), ways[home])
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()}))
    links, _ = brute_components(np.arange(6000), x)
    got = {r.id: r.n_links for r in multi_index.near_duplicates(docs).collect()}
    n = np.array([got[i] for i in range(6000)])
    assert (n <= links).all() and n.sum() >= 0.95 * links.sum(), (n.sum(), links.sum())


def test_visits_that_fall_short_are_not_taken_for_enough():
    rng = np.random.default_rng(11)
    sample = multi_index.normalised(rng.normal(size=(multi_index.SAMPLE, 64)))
    assert multi_index.MultiIndex(sample, 64).visits_for(multi_index.calibration_pairs(sample, 0.9), 0.98, 2) is None
    index, visits = multi_index.fitted_index(sample, 600_000, 0.9, 0.98)
    x = multi_index.normalised(rng.normal(size=(1000, 64)))
    y = turned(rng, x, np.linspace(0.9, 1, 1000, endpoint=False))
    met = [(a == b[0]).any() or (b == a[0]).any() for a, b in zip(index.traverse(x, visits), index.traverse(y, visits))]
    assert np.mean(met) >= 0.98, (index.k, visits, np.mean(met))


def test_duplicates_of_odd_rows(spark):
    d = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS links", "3 AS id")
    got = sorted(((r.id or -1, r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(d.drop("id")).collect()), key=str)
    want = [(-1, 3, 7, False), *[(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)], (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (10, 1, 10, True), (10, 1, 10, True)]
    assert got == sorted(want, key=str)
    assert multi_index.near_duplicates(d.drop("id").limit(0)).count() == 0
