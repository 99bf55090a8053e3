"""Tasks read at one look, against those that the fold over lines finds; plain steps; even parts of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.frames import spread
from lodestone.functions.text import iso_date
from lodestone.operators import checks
from lodestone.operators import markdown as M
from lodestone.operators import tasks as T
from lodestone.plans import views

NOTES = [
    "# Plan\n\n- [ ] one #task [due:: 2026-01-02] (k:: a) ^id\ntext\n* [x]  two #task#x [a:: [[L|x]]] [a:: 2] **b** _c_\n+ [X] three #tasks\n- [ ] #task",
    "- [ ] odd #task [a:: [b:: c]] (z:: q (in) [r]) [m:: 1)\n- [ ] [[x (y:: z)]] #task [[a::b]] [#no:: x]\n- [ ] #task [ :: v] [:: w] [k::] [k:: ]",
    "text\n- [ ] after text #task\nmore #task\n- [ ] again #task [[a]] ![i](u) [s](t) [ due:: 2026-02-29 ]\n-  [ ] wide #task\n - [ ] lead #task\n-[ ] none #task",
    "- [ ] code `#task` x\n- [ ] `[a:: 1]` #task [b:: 2]",
    "```\n- [ ] in code #task\n```\n- [ ] out #task",
    "<!--\n- [ ] gone #task\n-->\n- [ ] here #task \\[a:: 1]",
    "---\na: b\n---\n- [ ] front #task\n  - [ ] inner #task [repeat:: every day]\n> - [ ] quoted #task",
    "- [ ] crlf #task [a:: 1]\r\n- [ ] tab\t#task",
    "Title\n===\n- [ ] under #task\n- \n- [ ] x #task\n---\n- [ ] y #task (a:: b) trailing   blanks  ",
    "1. [ ] number #task\n- # [ ] #task\n- [ ] # head #task\n- [x] - [ ] nested #task\n##nohead #task\n- [ ] nbsp #task   x",
]


def test_plain_tasks_are_those_of_the_fold(spark):
    notes = spark.createDataFrame([(f"{i}.md", c) for i, c in enumerate(NOTES)], "path string, contents string")
    rows = lambda d: sorted(map(repr, d.withColumns({c: F.array_sort(F.map_entries(c)) for c in ("fields", "unknown_fields")}).collect()))
    got, want = rows(T.tasks(notes)), rows(T.tasks(M.extracted(notes, "tasks")))
    assert got == want and len(got) > 15
    # Plain notes meet no fold at all.
    assert notes.where(F.concat(F.lit("\n"), "contents").rlike(M.HARD)).count() == 8


def test_plain_steps_give_the_listed_days(spark):
    repeats = ["every day", "every 3 days", "Every other week", " every third day ", "every 0 days", "every 12345 days", "every week on monday", "every month", None, ""]
    dates = [("2026-01-01", None), ("2026-01-01", "2026-01-04"), (None, "2026-03-01"), ("2026-02-29", None)]
    d = spark.createDataFrame([(f"{i}-{j}", r, *x) for i, r in enumerate(repeats) for j, x in enumerate(dates)], "path string, repeat string, due string, scheduled string")
    d = d.withColumns({"done": F.lit(False), "completed": F.lit(None).cast("string"), "fields": F.create_map(F.lit("k"), F.lit("v"))}).localCheckpoint()
    due, scheduled = (F.try_to_date(c, "yyyy-MM-dd") for c in ("due", "scheduled"))
    shift, end = F.coalesce(F.datediff(scheduled, due), F.lit(0)), F.lit("2026-03-20").cast("date")
    listed = lambda until: T.occurrences(F.col("repeat"), F.coalesce(due, scheduled), until)
    day = F.coalesce(F.date_add(due, shift), F.col("scheduled").try_cast("date"))
    want = d.select("path", F.explode(listed(F.date_add(end, -shift))).alias("day"), shift.alias("s")).selectExpr("path", "date_add(day, s) AS day").where("day >= '2026-02-10'")
    got = T.expand_in_window(d, "2026-02-10", "2026-03-20").where("occurrence > 0").select("path", day.alias("day"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100
    last = d.select("path", F.array_max(listed(end)).alias("m")).where("m is not null")
    moved = T.latest_on_or_before(d, "2026-03-20").alias("a").join(d.alias("b"), "path").where("not (a.due <=> b.due and a.scheduled <=> b.scheduled)")
    assert sorted(moved.selectExpr("path", "cast(coalesce(a.due, a.scheduled) as date)").collect()) == sorted(last.collect())


def test_days_are_read_without_a_parser(spark):
    given = ["2026-02-28", "2026-02-29", "0000-01-01", "2026-1-1", "9999-12-31", "2026-01-01 ", "2026-01-01\n", ""]
    d = spark.createDataFrame([(g,) for g in given], "t string").select(iso_date(F.col("t")).alias("d"))
    assert [r.d for r in d.collect() if r.d] == ["2026-02-28", "9999-12-31"]


def test_large_tables_are_spread_by_rows(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    sizes = spread(spark.read.parquet(str(tmp_path / "t")), rows=10_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 11_000


def test_repeat_seeds_read_notes_once(spark):
    notes = spark.createDataFrame([("a.md", "- [x] Call #task [repeat:: every month] [due:: 2026-01-01]")], "path string, contents string")
    found = checks.check_repeat_seeds(T.tasks(notes))
    assert found.count() == 1 and "Scan ExistingRDD" in found._jdf.queryExecution().executedPlan().toString()


def test_notes_are_made_after_their_table_is_spread(spark):
    table = spread(spark.range(10).withColumnRenamed("id", "k"))
    notes = table.select(F.format_string("%d.md", "k").alias("path"), F.concat(F.lit("- [ ] do #task [[x]] [k:: "), "k", F.lit("]")).alias("contents"))
    for d in (T.tasks(notes), M.links(notes)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan
        for below in plan.split("Repartition")[1:]:
            assert "#task" not in below.split("Range")[0] and "[[" not in below.split("Range")[0]
        assert d.count() == 10


def test_plain_fields_are_trimmed_by_their_pattern(spark):
    body = " [ due ::  2026-01-02  ] (a b:: [[L x]]  (?) [k::] [l::   ] (m::n o  [[P]]) [ : :: x] [a b::  last of  two ] ![q:: r:s::t ]"
    long = "word " * 40_000
    notes = spark.createDataFrame([("a.md", f"- [ ] one #task{body}"), ("b.md", f"- [ ] two #task [z::  {long}] [y:: 1]")], "path string, contents string")
    rows = lambda d: sorted(map(repr, d.select("path", "text", F.array_sort(F.map_entries("fields"))).collect()))
    short = notes.where("path = 'a.md'")
    assert rows(T.tasks(short)) == rows(T.tasks(M.extracted(short, "tasks")))
    flat = T.tasks(spark.createDataFrame([("c.md", "- [ ] c #task [ due ::  2026-01-02  ] (a b:: [[L x]]  ) [k::] [l::   ] (m::n o  [[P]]) ![q:: r s ]")], "path string, contents string"))
    assert flat.first()["fields"] == {"due": "2026-01-02", "a b": "[[L x]]", "k": "", "l": "", "m": "n o  [[P]]", "q": "r s"}
    # A value as long as this doesn't fill the stack of the pattern's matcher.
    found = T.tasks(notes.where("path = 'b.md'")).first()["fields"]
    assert found == {"z": long.strip(), "y": "1"}


def test_fields_are_found_at_one_look(spark):
    body = "[ due ::  2026-01-02  ] (a b:: [[L x]]  ) [k::] [l::   ] (m::n o  [[P]]) [ :: v] [ q  r ::s]"
    notes = spark.createDataFrame([("a.md", f"- [ ] x #task {body.replace(' [ :: v]', '')} #last"), ("b.md", f"- [ ] y #task {body}")], "path string, contents string")
    got = {r.path: r for r in M.task_items(notes).collect()}
    assert got["a.md"]["keys"] == ["due", "a b", "k", "l", "m", "q  r"] and got["a.md"]["values"] == ["2026-01-02", "[[L x]]", "", "", "n o  [[P]]", "s"]
    assert got["a.md"].free.split() == ["x", "#task", "#last"] and got["a.md"].tags == ["#task", "#last"]
    # A bracket that is no field's is left, so places count.
    assert got["b.md"]["keys"] is None and got["b.md"].free is None and len(got["b.md"].spans) == 6


def test_checks_explode_rows_that_a_projection_made(spark):
    notes = spark.createDataFrame([("a.md", "- [x] x #task [due:: 2026-02-30] [size:: 3] [bulk:: 1]"), ("b.md", "- [ ] y #task [due:: 2026-03-01] [area:: [[A]]] [project:: [[P]]]")], "path string, contents string")
    found = checks.check_tasks(T.tasks(notes))
    assert "Generate explode(found_" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.message for r in found.collect()) == ["Done task without a completed date", "Invalid due date: 2026-02-30", "Unknown field: bulk", "Unknown field: size"]


def test_only_open_tasks_are_expanded(spark):
    rows = [("a", True, "2026-01-05", None, "every day"), ("b", False, "2026-01-01", None, "every week"), ("c", False, "2026-01-09", None, None), ("d", False, None, "2026-01-02", "every 5 days"), ("e", True, "2026-01-06", None, None)]
    d = spark.createDataFrame(rows, "path string, done boolean, due string, scheduled string, repeat string").withColumns({"completed": F.lit(None).cast("string"), "fields": F.create_map(F.lit("k"), F.lit("v"))})
    week, due = views.in_week(d, "2026-01-05"), views.due_by(d, "2026-01-08")
    assert sorted(r.path for r in week.collect()) == ["b", "c", "d"] and sorted((r.path, r.due) for r in due.collect()) == [("b", "2026-01-08")]
    for found in (week, due, views.on_day(d, "2026-01-08")):
        below = found._jdf.queryExecution().optimizedPlan().toString().rsplit("Generate", 1)[1]
        assert "NOT done" in below


def test_marks_of_fields_are_made_once_without_a_generator(spark):
    notes = spark.createDataFrame([("a.md", "- [ ] x #task [due:: 2026-03-01] (k:: v) [k:: w]")], "path string, contents string")
    tasks = T.tasks(notes)
    for d in (tasks, tasks.select("path", "unknown_fields"), tasks.select("path", "due", "text").where(~F.col("done") & F.col("due").isNotNull())):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("\x00$1$3\x01$2$4\x00") == 1 and "struct(marked_" not in plan
    assert tasks.first()["unknown_fields"] == {"k": "w"}
