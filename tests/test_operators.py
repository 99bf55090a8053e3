"""Operators on small hand-written notes and records."""

from __future__ import annotations

from datetime import date

import pytest
from lodestone.functions import values as V
from lodestone.operators import markdown as M
from lodestone.operators import notequery, render
from lodestone.operators import tasks as T
from lodestone.sources import vault
from pyspark.sql import functions as F

NOTE = """---
title: Poem
tags: [plain, nested/child]
---
# Title with [[Page|shown]]
text #tag `#code` [[Other#Part]] ![[pic.png]] [[#^anchor]] [mood:: calm] ^here

```dataview
# no heading
LIST
```
Under
=====
1. first (when:: [[Now]])
- [X] done #task [due:: 2026-02-29] [due:: 2026-03-01]
  - [ ] child
"""


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([("a/n.md", NOTE), ("e.md", ""), ("null.md", None), ("open.md", "~~~\n# code\n#x")], "path string, contents string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_families(notes):
    assert rows(M.headings(notes), "line", "depth", "text") == [(5, 1, "Title with shown"), (12, 1, "Under")]
    assert rows(M.links(notes).where("line = 6"), "ord", "target", "header", "block", "embed") == [(0, "Other", "Part", None, False), (1, "pic.png", None, None, True), (2, "", None, "anchor", False)]
    assert rows(M.tags(notes), "line", "value") == [(6, "#tag"), (15, "#task")]
    assert rows(M.frontmatter(notes), "key", "value") == [("tags", "[plain, nested/child]"), ("title", "Poem")]
    assert rows(M.inline_fields(notes), "line", "key", "value") == [(6, "mood", "calm"), (14, "when", "[[Now]]"), (15, "due", "2026-02-29"), (15, "due", "2026-03-01")]
    assert rows(M.fenced_blocks(notes), "path", "line", "language", "value") == [("a/n.md", 8, "dataview", "# no heading\nLIST"), ("open.md", 1, None, "# code\n#x")]
    assert rows(M.block_anchors(notes), "id") == [("here",)]
    assert rows(M.list_items(notes), "line", "checked") == [(14, None), (15, True), (16, False)]


def test_tasks(notes):
    (t,) = T.tasks(notes).collect()
    assert (t.line, t.done, t.text, t.due, t.fields) == (15, True, "done", "2026-03-01", {"due": "2026-03-01"})


@pytest.mark.parametrize(
    ("repeat", "days"),
    [("every week", [13, 20]), ("every 5 days", [11, 16, 21]), ("every weekday", [8, 9, 10, 13, 14, 15, 16, 17, 20, 21]), ("every week on monday and friday", [10, 13, 17, 20]), ("weekly", []), ("every day when done", []), (None, [])],
)
def test_occurrences(spark, repeat, days):
    d = spark.createDataFrame([(repeat,)], "r string").select(T.occurrences(F.col("r"), F.lit("2026-07-06").cast("date"), F.lit("2026-07-21").cast("date")).alias("o")).first()
    if repeat == "every weekday":
        days = [7, *days]
    assert d.o == [date(2026, 7, n) for n in days]


def test_months_skip_days_that_they_lack(spark):
    d = spark.range(1).select(T.occurrences(F.lit("every month"), F.lit("2026-01-31").cast("date"), F.lit("2026-06-01").cast("date")).alias("o")).first()
    assert d.o == [date(2026, 3, 31), date(2026, 5, 31)]


def test_null_is_greatest(spark):
    d = spark.createDataFrame([(1, None, []), (2, 5.0, ["x"]), (3, 0.0, ["y"])], "k int, v double, a array<string>")

    def kept(c):
        return [r.k for r in d.where(c).orderBy("k").collect()]

    v = V.field(d, "v")
    assert kept(V.ge(v, V.literal(4))) == [1, 2] and kept(V.lt(v, V.literal(4))) == [3] and kept(V.ne(v, V.literal(5))) == [1, 3]
    assert kept(V.eq(V.field(d, "missing"), V.literal(None))) == [1, 2, 3]
    assert kept(V.truthy(v)) == [2] and kept(V.truthy(V.field(d, "a"))) == [2, 3]
    assert kept(V.eq(V.field(d, "a"), V.literal("x"))) == [2]
    assert kept(V.contains(V.field(d, "missing"), V.literal("iss"))) == [1, 2, 3]


def test_groups_keep_rows_and_count_places(spark):
    d = spark.createDataFrame([(1, "Home", "b"), (2, "Work", "a"), (3, "Home", "c"), (4, None, "d")], "k int, area string, due string")
    q = notequery.NoteQuery(d, ("k",)).sort("due").group_by("area").limit(4)
    assert [(r.key, r.row_indexes) for r in q.groups().collect()] == [("Work", [0]), ("Home", [1, 2]), ("", [3])]
    with pytest.raises(ValueError, match="positive"):
        q.limit(0)


def test_pushed_filters(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = notequery.NoteQuery(d, ("o_orderkey",)).compare("o_totalprice", ">=", 400000).show("o_orderkey").run().rows._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(IsNull(o_totalprice),GreaterThanOrEqual(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_reading_a_folder(spark, tmp_path):
    for name, text in {"a.md": "# A", "sub/b.md": "# B", "sub/c.txt": "no", "old/d.md": "# D", ".kbignore": "old/\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert rows(vault.read_notes(spark, str(tmp_path)), "path", "contents") == [("a.md", "# A"), ("sub/b.md", "# B")]
    assert rows(vault.read_notes(spark, str(tmp_path), "sub"), "path") == [("sub/b.md",)]


def test_markdown_table(spark):
    d = spark.createDataFrame([("a|b\nc", ["x", None])], "t string, l array<string>")
    assert render.markdown_table(d) == "| t | l |\n| --- | --- |\n| a\\|b<br>c | x,  |"


def test_findings_do_not_grow_with_their_group(spark):
    from lodestone.operators import checks

    notes = spark.createDataFrame([(f"{'Archive' if n % 3 == 0 else 'a'}/{n}/same.md", "# Same\n# Same\n[[same]] [[../no]]") for n in range(30)], "path string, contents string")
    for found, paths, n in (
        (checks.check_duplicate_headings(notes), checks.heading_paths(notes), {19}),
        (checks.check_archive_headings(notes), checks.archive_heading_paths(notes), {10, 20}),
        (checks.check_links(notes), checks.link_paths(notes), {0, 29}),
    ):
        assert tuple(found.columns) == checks.FINDING and "array" not in str(found.dtypes)
        rows = checks.with_related_paths(found, paths).collect()
        assert {r.n_related for r in rows} == n and len(rows) == found.count()
        assert all(len(r.related_paths) == r.n_related and r.path not in r.related_paths for r in rows)


CODED = """---
type: log
tags: [a, b/c]
Due Date: 2026-01-05
---
# Use `grep` **well** [[Page|shown]] [site](http://x.y)

    - [ ] code #task [[no]] [x:: 1]

- item `[[not]]` (who:: [[Ann]]) [run:: `ls -a`]
    - [ ] nested `c` *open* #task [due:: 2026-01-01]
plain text
    still text [[Old]]

Second `[[Old]]` [[Old#h|x]] kind:: a
kind:: a

```
[[Old]]
```
\tdeep code
more:: v
"""


def test_code_hides_syntax_but_not_text(spark):
    d = spark.createDataFrame([("f/n.md", CODED)], "path string, contents string")
    assert rows(M.headings(d), "line", "text") == [(6, "Use grep well shown site")]
    assert rows(M.links(d), "line", "target") == [(6, "Page"), (10, "Ann"), (13, "Old"), (15, "Old")]
    assert rows(M.inline_fields(d), "line", "key", "value") == [(10, "run", "`ls -a`"), (10, "who", "[[Ann]]"), (11, "due", "2026-01-01")]
    assert rows(M.list_items(d), "line", "checked", "text") == [(10, None, "item [[not]] Ann ls -a"), (11, False, "nested c open #task 2026-01-01")]
    (t,) = T.tasks(d).collect()
    assert (t.line, t.text, t.due) == (11, "nested c open", "2026-01-01")
    assert rows(M.code_blocks(d), "line", "value") == [(8, "- [ ] code #task [[no]] [x:: 1]"), (18, "[[Old]]"), (21, "deep code")]
    assert M.renamed_links(d, "Old", "N$w").first().contents == CODED.replace("still text [[Old]]", "still text [[N$w]]").replace("[[Old#h", "[[N$w#h")


def test_page_records(spark):
    from lodestone.operators.pages import page_records

    pages = page_records(spark.createDataFrame([("f/n.md", CODED), ("e.md", None)], "path string, contents string"))
    (p, e) = pages.orderBy(F.desc("`file.path`")).collect()
    assert (p["file.name"], p["file.folder"], p["file.ext"], p["file.outlinks"]) == ("n", "f", "md", ["Page", "Ann", "Old", "Old"])
    assert p["file.etags"] == ["#a", "#b/c", "#task"] and p["file.tags"] == ["#a", "#b", "#b/c", "#task"]
    assert p["file.frontmatter"] == ["type | log", "Due Date | 2026-01-05"]
    assert p.fields["due-date"] == ["2026-01-05"] and p.fields["who"] == ["[[Ann]]"] and p.fields["kind"] == ["a"] and p.fields["more"] == ["v"]
    assert (e["file.name"], e["file.tags"], e.fields) == ("e", [], {})
    q = notequery.NoteQuery(pages, ("file.path",)).source("f").compare("type", "=", "log").show("due-date").run()
    assert [r[0] for r in q.rows.collect()] == [["2026-01-05"]] and q.metadata == {"source": "f"}
    several = notequery.NoteQuery(pages, ("`file.path`",)).source("#b", "e", every=False).named("LIST")
    assert several.records().count() == 2 and several.run().metadata == {"source": True, "query": "LIST"}
    assert '"source": "f"' in render.json_document(q) and '"label": "due-date"' in render.json_document(q)


@pytest.mark.parametrize(
    ("repeat", "days"),
    [("every monday", ["07-13", "07-20", "07-27", "08-03"]), ("every other week", ["07-20", "08-03"]), ("every month on the 1st and 15th", ["07-15", "08-01"]), ("every july", []), ("every month on Monday", ["07-13", "07-20", "07-27", "08-03"]), ("every 0 days", []), ("every 2 months on the 9th", ["07-09"])],
)
def test_repeats_that_name_days(spark, repeat, days):
    d = spark.createDataFrame([(repeat,)], "r string").select(T.occurrences(F.col("r"), F.lit("2026-07-06").cast("date"), F.lit("2026-08-08").cast("date")).alias("o"), T.repeat_status(F.col("r")).alias("s")).first()
    assert [x.strftime("%m-%d") for x in d.o] == days and d.s == ("parse-error" if "0 days" in repeat else "supported")


def test_latest_occurrence_is_bounded_by_the_cutoff_itself(spark):
    from lodestone.plans import views

    note = "- [ ] a #task [due:: 2026-06-01] [scheduled:: 2026-05-25] [repeat:: every week]\n- [ ] b #task [due:: 2026-06-01] [scheduled:: 2026-06-05] [repeat:: every week]\n- [x] c #task [due:: 2026-05-01] [repeat:: every day]"
    d = T.tasks(spark.createDataFrame([("n.md", note)], "path string, contents string"))
    got = {r.text: (r.due, r.scheduled, r.fields["due"], r.fields.get("scheduled")) for r in T.latest_on_or_before(d, "2026-06-10").collect()}
    assert got == {"a": ("2026-06-08", "2026-06-01", "2026-06-08", "2026-06-01"), "b": ("2026-06-08", "2026-06-12", "2026-06-08", "2026-06-12"), "c": ("2026-05-01", None, "2026-05-01", None)}
    assert {r.text for r in views.due_by(d, "2026-06-10").collect()} == {"a", "b"}
    assert {(r.text, r.due) for r in views.TaskQuery(d).by("2026-06-10").where(~F.col("done")).records().collect()} == {("a", "2026-06-08"), ("b", "2026-06-08")}
    assert {(r.text, r.due) for r in views.TaskQuery(d).on("2026-06-08").records().collect()} == {("a", "2026-06-08"), ("a", "2026-06-15")} & {(r.text, r.due) for r in views.on_day(d, "2026-06-08").collect()}


def test_groups_without_a_limit_keep_every_place(spark):
    d = spark.range(20_000).selectExpr("id AS k", "cast(id % 3 as string) AS g", "id * 7919 % 20011 AS v").repartition(7)
    for q in (notequery.NoteQuery(d, ("k",)).group_by("g"), notequery.NoteQuery(d, ("k",)).sort("-v").group_by("g")):
        got = {r.key: r.row_indexes for r in q.groups().collect()}
        assert sorted(i for x in got.values() for i in x) == list(range(20_000))
        want = [r.g for r in d.orderBy(*(q.keys or ()), "k").collect()] if q.keys else None
        if want:
            assert all(want[i] == g for g, x in got.items() for i in x)


def test_checks_of_chosen_notes_and_bundles(spark):
    from lodestone.operators import checks

    done = "- [x] call #task [area:: [[A]]] [project:: [[P]]] [repeat:: every week] [completed:: 2026-01-0{}]"
    notes = spark.createDataFrame(
        [("a.md", "# b\n[[no]]"), ("b.md", "# b\n[[gone]]"), ("dump.md", "Title\n=====\n\nleft"), ("x/DUMP.md", "# X\nleft"), ("bad.md", "---\njust words\n---\n[[no]]"), ("none.md", None), ("t.md", done.format(1) + "\n" + done.format(2))],
        "path string, contents string",
    )
    found = checks.bundle("all").run(notes).collect()
    assert sorted(r.path for r in found if r.category == "catalog") == ["bad.md", "none.md"]
    assert [(r.path, r.line) for r in found if r.category == "dump"] == [("dump.md", 4)]
    assert [(r.path, r.line) for r in found if "no later open" in r.message] == [("t.md", 2)]
    assert sorted(r.path for r in found if r.category == "links") == ["a.md", "b.md"] + ["t.md"] * 2
    chosen = spark.createDataFrame([("./a.md",)], "path string")
    some = checks.bundle("headings").run(notes, chosen).collect()
    assert {r.path for r in some} == {"a.md"} and [r.n_related for r in some if r.category == "headings"] == [1]
    more = checks.bundle("dump").add(lambda n: checks.finding(n, "own", "warning", F.lit("seen")))
    assert {r.category for r in more.run(notes).collect()} == {"dump", "own"}
    assert [(r.category, r.ord) for r in checks.categories(more.run(notes)).orderBy("ord").collect()] == [("own", 0), ("dump", 1)]


def test_functions_by_name(spark):
    d = spark.createDataFrame([("today", ["a"])], "w string, t array<string>")
    w, t = V.field(d, "w"), V.field(d, "t")
    terms = [V.call("date", w, today="2026-01-02"), V.call("contains", t, V.literal("a"), today=""), V.call("lower", w, today="")]
    assert tuple(d.select(*[V.text(x).alias(f"c{n}") for n, x in enumerate(terms)]).first()) == ("2026-01-02", "true", None)


def test_hidden_and_broken_notes_are_read(spark, tmp_path):
    for name, text in {"_a.md": b"# A", ".h/b+c d.md": b"# B", "sub/_x/c.md": b"# C", "bad.md": b"\xff\xfe\x00", "ok.md": b"# O"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = vault.read_notes(spark, str(tmp_path))
    assert rows(got.where("error is null"), "path", "contents") == [(".h/b+c d.md", "# B"), ("_a.md", "# A"), ("ok.md", "# O"), ("sub/_x/c.md", "# C")]
    assert rows(vault.failures(got), "path") == [("bad.md",)] and vault.note_at(got, "bad.md").first().error


def noted(spark, text: str):
    return spark.createDataFrame([("n.md", text)], "path string, contents string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Task [due:: 2022-04-05] and (priority:: high)", [("due", "2022-04-05"), ("priority", "high")]),
        ("[area:: [[Ops]]] [ref:: ^send-mail]", [("area", "[[Ops]]"), ("ref", "^send-mail")]),
        ("[[Key Note]]:: outside [ [[Key Note]]:: value]", [("[[Key Note]]", "value")]),
        ("[a:: [b:: c]] [x:: y]", [("x", "y")]),
        ("[k:: a (b) c] (k:: a (b) [c) (d]) [k:: a [b] c]", [("k", "a (b) c"), ("k", "a (b) [c"), ("k", "a [b] c")]),
        ("[🎅:: a console game] [Noël:: Un jeu]", [("🎅", "a console game"), ("Noël", "Un jeu")]),
        ("[:: no] [ :: no] [open:: [x] (a:: b", []),
        ("[a (b):: c] [a]b:: c] ((x:: y))", [("a (b)", "c"), ("(x", "y")]),
        ("`[x:: y]` <b [x:: y]> [ok:: yes] <!-- [x:: y]", [("ok", "yes"), ("x", "y")]),
    ],
)
def test_fields_by_depth_of_brackets(spark, text, want):
    assert [(r.key, r.value) for r in M.inline_fields(noted(spark, text)).orderBy("ord").collect()] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[[T]] [[T#H]] [[#H]] [[#^b-1]] [[T#^b|A]]", [("T", None, None, None), ("T", "H", None, None), ("", "H", None, None), ("", None, "b-1", None), ("T", None, "b", "A")]),
        ("![[Folder [Draft]/Note.md#Header|Embed [x]]] [[#]] [[a##b]] [[a#^x y]] [[^^q]]", [("Folder [Draft]/Note.md", "Header", None, "Embed [x]")]),
        ("| [[T\\|al]] | `[[no]]` |\n| --- | --- |\n<!-- [[no]]\n[[no]] --> [[no]]\n\n[[a\nb]] [[c]]", [("T", None, None, "al"), ("c", None, None, None)]),
    ],
)
def test_parts_of_links(spark, text, want):
    assert [(r.target, r.header, r.block, r.alias) for r in M.links(noted(spark, text)).orderBy("line", "ord").collect()] == want


def test_blocks_in_quotes_and_items(spark):
    text = "> > # Deep\n> - a\n>   1. b\n>\n>          code\n>\n>      # c\nlazy?\n\n- x\n\n  para\n  ~~~\n  # no\n  ~~~\n# yes\n* * *\n10) ten\n    more\n- [X]  done\n-\n  late"
    d = noted(spark, text)
    assert rows(M.headings(d), "line", "text") == [(1, "Deep"), (7, "c"), (16, "yes")]
    assert rows(M.list_items(d), "line", "indent", "text") == [(2, 2, "a"), (3, 4, "b"), (10, 0, "x"), (18, 0, "ten"), (20, 0, "done"), (21, 0, "")]
    assert rows(M.code_blocks(d).where("language is null"), "line", "value") == [(5, "code"), (13, "# no")]
    long = noted(spark, "\n".join(["- item", "  text [[L]]", ""] * 200))  # over the pieces that lines are folded in
    assert M.list_items(long).count() == 200 and rows(M.links(long), "line") == [(n,) for n in range(2, 601, 3)]


@pytest.mark.parametrize(
    ("text", "json"),
    [
        ("a: 1\nb:\n- x\n- y: 2\n  z: [p, 'q''r', \"s\\n\"]", '{"a":1,"b":["x",{"y":2,"z":["p","q\'r","s\\n"]}]}'),
        ("a:\n  b:\n    c: 1.5\n  d: ~\ne: TRUE\nf: 0x1F\ng: 007\nh: 1e2x", '{"a":{"b":{"c":1.5},"d":null},"e":true,"f":31,"g":7,"h":"1e2x"}'),
        ("a: |\n  one\n    two\n\n  three\nb: >-\n  x\n  y\n\n  z\nc: >\n  end\n", '{"a":"one\\n  two\\n\\nthree\\n","b":"x y\\nz","c":"end\\n"}'),
        ("a: plain\n  goes on\n  still\nb: [1,\n  2]\nc: {k: v, l: [m]}\nd: \"x # y\" # z", '{"a":"plain goes on still","b":[1,2],"c":{"k":"v","l":["m"]},"d":"x # y"}'),
        ("date: 2024-01-02\nurl: http://a/b\ntime: 12:30\n'q k': [[Note]]\nempty:\n", '{"date":"2024-01-02","empty":null,"q k":[["Note"]],"time":"12:30","url":"http://a/b"}'),
        ("- - 1\n  - 2", None), ("a: b\n  c: d", None), ("a: 1\na: 2", None), ("a: 'x", None), ("a:\n - b\n  - c\nd", None), ("text", None),
    ],
)
def test_yaml(spark, text, json):
    from json import loads

    from lodestone.functions.yaml import block_json

    got = spark.createDataFrame([(text.split("\n"),)], "l array<string>").select(F.to_json(F.try_parse_json(block_json(F.col("l"))))).first()[0]
    assert (None if got is None else loads(got)) == (None if json is None else loads(json))


def test_typed_values_compare_by_their_types(spark):
    from lodestone.operators.pages import page_records

    notes = spark.createDataFrame([(f"{n}.md", f"---\nsize: {v}\nin: {{deep: {n}}}\n---\n") for n, v in enumerate(["7", "10", "'9'", "x", "[8, 1]", "~", "{a: 1}"])], "path string, contents string")
    q = notequery.NoteQuery(page_records(notes), ("`file.path`",))
    kept = lambda op, x: [r["file.path"][0] for r in q.compare("size", op, x).records().orderBy("`file.path`").collect()]
    # Numbers by size, '9' and x by text, null and maps as the greatest of all.
    assert kept(">=", 8) == ["1", "2", "3", "4", "5", "6"] and kept("<", 8) == ["0"] and kept("=", "9") == ["2"] and kept("=", 8) == ["4"]
    assert [r[0] for r in q.compare("size", "<=", 100).sort("-size").show("in.deep").run().rows.collect()] and q.compare("in.deep", "=", 3).records().count() == 1
    assert [r[0] for r in q.where(q.term("size")).sort("size").show("size").run().rows.collect()][:3] == [["7"], ["8", "1"], ["10"]]


@pytest.mark.parametrize(
    ("repeat", "days"),
    [
        ("every month on the 2nd Friday", ["2026-02-13", "2026-03-13", "2026-04-10"]), ("every month on the last friday", ["2026-01-30", "2026-02-27", "2026-03-27"]), ("every 2 months on the 2nd last friday", ["2026-01-23", "2026-03-20"]),
        ("every month on the first monday and third wednesday for 4 times", ["2026-01-21", "2026-02-02", "2026-02-18", "2026-03-02"]), ("every day for 3 times", ["2026-01-10", "2026-01-11"]),
        ("every week until January 25, 2026", ["2026-01-16", "2026-01-23"]), ("every week until 2026-01-16", ["2026-01-16"]), ("every week until someday", []), ("every month on the last day", ["2026-01-31", "2026-02-28", "2026-03-31"]),
        ("every february on the 1st monday", ["2026-02-02"]), ("every year on the 10th sunday", ["2026-03-08"]), ("every month on the 6th friday", []),
    ],
)
def test_ordinal_and_bounded_repeats(spark, repeat, days):
    d = spark.range(1).select(T.occurrences(F.lit(repeat), F.lit("2026-01-09").cast("date"), F.lit("2026-04-12").cast("date")).alias("o"), T.repeat_status(F.lit(repeat)).alias("s")).first()
    assert [str(x) for x in d.o] == days and d.s == ("parse-error" if "someday" in repeat else "supported")


def test_notes_are_parsed_once(spark):
    from lodestone.operators.pages import page_records
    from lodestone.operators.search import search_notes

    d = noted(spark, "# a\n[[b]] #c [d:: e]")
    for df in (page_records(d), search_notes(d, "b"), M.note_tags(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        # What makes the blocks stands in one generator.
        assert len([x for x in plan.split("\n") if "Generate inline" in x and "AS rows" in x]) <= 1
    ready = M.extracted(d)
    assert "aggregate" not in M.links(spark.createDataFrame(ready.collect(), ready.schema))._jdf.queryExecution().optimizedPlan().toString()
