"""Paths of large groups: each finding's whole list, without a group's findings times its paths on the way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import checks
from lodestone.queries import QUERIES


def made_rows(df) -> int:
    """The most rows that an operator of df's plan has made."""

    def walk(p):
        metric = p.metrics().get("numOutputRows")
        yield metric.get().value() if metric.isDefined() else 0
        inner = [p.executedPlan()] if "AdaptiveSparkPlan" in p.nodeName() else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        for x in inner:
            yield from walk(x)

    return max(walk(df._jdf.queryExecution().executedPlan()))


def found_in(d):
    """Findings of rows (path, line, n_related, related_key)."""
    return checks.finding(d, "c", "error", F.lit("m"), F.col("line"), F.col("n"), F.col("key"))


@pytest.mark.parametrize("copy_rows", [1, 7, 256])
def test_lists_are_whole_however_they_are_copied(spark, monkeypatch, copy_rows):
    monkeypatch.setattr(checks, "COPY_ROWS", copy_rows)
    near = [("big", f"n{i:02}") for i in range(40)] + [("big", "n00"), ("one", "x"), ("unasked", "y"), (None, "z"), ("gap", None), ("gap", "g")]
    asked = [(f"n{i:02}", 1, "big") for i in range(45)] + [("n00", 1, "big"), ("n01", None, "big"), ("x", 2, "one"), ("a", 1, "one"), ("a", 1, "absent"), ("a", 1, None), (None, 1, "big"), ("g", 1, "gap")]
    found = found_in(spark.createDataFrame(asked, "path string, line int, key string").withColumn("n", F.lit(0)))
    got = checks.with_related_paths(found, spark.createDataFrame(near, "key string, path string"))
    assert got.columns == [*checks.FINDING, "related_paths"] and dict(got.dtypes)["related_paths"] == "array<string>"
    want = [(p, n, k, sorted({o for key, o in near if k is not None and key == k and p is not None and o not in (None, p)})) for p, n, k in asked]
    assert sorted(map(repr, want)) == sorted(repr((r.path, r.line, r.related_key, r.related_paths)) for r in got.collect())


def test_large_groups_meet_no_pairs_of_archived_notes(spark):
    notes = spark.range(1200).select(F.format_string("%s/%d.md", F.when(F.col("id") % 2 == 0, "Archive").otherwise("a"), "id").alias("path"), F.lit("# Same").alias("contents"))
    notes = checks.parsed_once(notes, "headings")
    df = checks.with_related_paths(checks.check_archive_headings(notes), checks.archive_heading_paths(notes))
    rows = df.collect()
    assert len(rows) == 1200 and all(len(r.related_paths) == 600 and r.related_paths == sorted(r.related_paths) for r in rows)
    assert {r.related_paths[0].startswith("a/") == r.path.startswith("Archive/") for r in rows} == {True}
    # 600 notes times 600 on each side before.
    assert made_rows(df) <= 2 * 1200


def test_large_groups_meet_no_pairs_of_like_headings(spark):
    notes = spark.range(1000).select(F.format_string("a/%d.md", "id").alias("path"), F.lit("# Same").alias("contents"))
    notes = checks.parsed_once(notes, "headings")
    df = checks.with_related_paths(checks.check_duplicate_headings(notes), checks.heading_paths(notes))
    rows, paths = df.collect(), sorted(f"a/{n}.md" for n in range(1000))
    assert len(rows) == 1000 and all(r.related_paths == [p for p in paths if p != r.path] for r in rows)
    # 1000 notes times 1000 before.
    assert made_rows(df) <= 2 * 1000


@pytest.mark.parametrize("name", ["check_duplicate_h1", "check_archive_collision", "check_links"])
def test_findings_and_paths_are_of_one_parse(spark, name):
    # The second parse, that of the paths, read the tables again.
    assert "parquet" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().lower()
