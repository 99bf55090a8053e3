"""Integrity checks of notes: findings (category, severity, path, line, message, n_related, related_key) by joins and aggregations.

A finding counts the other notes that it concerns, exactly, and names their group by a key; their paths are rows
(key, path) of a second DataFrame.  So no row grows with a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions import values as V
from ..functions.frames import held, kept, materialised
from ..functions.text import base_name, day_of, folder_of, is_archived, is_wikilink, normal_key, resolved_path, title_of
from ..sources.vault import failures, readable
from . import markdown as M
from .tasks import ALLOWED_FIELDS, DATE_FIELDS, repeat_status
from .tasks import tasks as task_records

FINDING = ("category", "severity", "path", "line", "message", "n_related", "related_key")


def finding(d: DataFrame, category: str, severity: str, message: Column, line: Column | None = None, n: Column | None = None, key: Column | None = None) -> DataFrame:
    return d.select(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), "path", (F.lit(None) if line is None else line).cast("int").alias("line"), message.alias("message"),
        (F.lit(0) if n is None else n).cast("long").alias("n_related"), (F.lit(None) if key is None else key).cast("string").alias("related_key"),
    )


#: Findings of a group that share one copy of its paths, and findings of one task.
COPY_ROWS, RESULT_ROWS = 256, 1024


def with_related_paths(findings: DataFrame, related: DataFrame) -> DataFrame:
    """findings with related_paths, the sorted paths of each one's group in related (key, path) but its own.

    A group's paths are gathered once and copied for each COPY_ROWS of its findings, so that a large group is the work of many tasks, and nothing but the result is a group's
    findings times its paths.  Where that is too much, join related by its key instead.
    """
    found, none = materialised(findings.select(*FINDING)), F.array().cast("array<string>")
    counts = found.where("related_key is not null").groupBy("related_key").agg(F.ceil(F.count("*") / COPY_ROWS).cast("int").alias("copies_"))
    near = related.withColumnRenamed("key", "related_key").join(counts, "related_key", "left_semi")
    groups = near.groupBy("related_key").agg(F.sort_array(F.collect_set("path")).alias("group_")).join(counts, "related_key")
    copies = groups.select("related_key", "group_", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1)).alias("copy_"))
    d = found.join(counts, "related_key").withColumn("copy_", F.pmod(F.xxhash64("path", "line", "message"), "copies_").cast("int")).drop("copies_")
    # How large rows become, their sizes before the join don't tell: neither are partitions merged by these nor copies broadcast.
    parts = max(found.sparkSession.sparkContext.defaultParallelism, -(-found.count() // RESULT_ROWS))
    d, copies = (x.repartition(parts, "related_key", "copy_") for x in (d, copies))
    d = d.join(copies.hint("merge"), ["related_key", "copy_"], "left").select(*FINDING, F.coalesce(F.array_remove("group_", F.col("path")), none).alias("related_paths"))
    return d.unionByName(found.where("related_key is null").withColumn("related_paths", none))


def parsed_once(notes: DataFrame, *families: str) -> DataFrame:
    """notes with the families' records, materialised, so that what a check joins them with doesn't parse them again."""
    ready = M.extracted(notes, *families)
    return notes if ready is notes else materialised(ready.select("path", *[M.FAMILIES[f][0] for f in families]))


def first_headings(notes: DataFrame) -> DataFrame:
    """(path, line, text) of each note's first heading of depth 1."""
    top = M.headings(notes).where("depth = 1").groupBy("path").agg(F.min(F.struct("line", "text")).alias("h"))
    return top.select("path", "h.line", "h.text")


def note_keys(notes: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """(key, path, by_path): what a link may name a note by; its path, its file name, its top headings."""
    tops = (M.headings(notes) if headings is None else headings).where("depth = 1").select(normal_key(F.col("text")).alias("key"), "path", F.lit(False).alias("by_path"))
    paths = notes.select(normal_key(F.col("path")).alias("key"), "path", F.lit(True).alias("by_path"))
    names = notes.select(normal_key(base_name(F.col("path"))).alias("key"), "path", F.lit(False).alias("by_path"))
    return paths.unionByName(names).unionByName(tops).groupBy("key", "path").agg(F.max("by_path").alias("by_path"))


def link_paths(notes: DataFrame) -> DataFrame:
    """(key, path) of the notes that a link's key names."""
    keys = note_keys(notes)
    return keys.select("key", "path").unionByName(keys.where("by_path").select(F.concat(F.lit("\0"), "key").alias("key"), "path"))


def resolved_links(notes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Links (of the notes `of`, where they are given) with the number of paths that they name, `named`, and the key of these in link_paths.

    Where a target with an inner '/' names nothing, it is tried against the note's folder; such a key is led by a NUL and
    stands for paths only (see link_paths).
    """
    return _resolved(M.links(notes if of is None else of), link_paths(notes))


def _resolved(links: DataFrame, paths: DataFrame) -> DataFrame:
    d = links.where("target <> ''").withColumn("key", normal_key(F.col("target")))
    relative = F.contains(F.col("target"), F.lit("/")) & ~F.col("target").startswith("/")
    d = d.withColumn("relative_key", F.when(relative, F.concat(F.lit("\0"), normal_key(resolved_path(folder_of(F.col("path")), F.col("target"))))))
    # Each link asks for its one or two keys; one aggregation tells how many paths a key has.
    counts = paths.groupBy("key").agg(F.count("*").alias("n"))
    out = d.join(counts.withColumnRenamed("n", "direct"), "key", "left").join(counts.select(F.col("key").alias("relative_key"), F.col("n").alias("near")), "relative_key", "left")
    out = out.withColumn("key", F.when(F.col("direct").isNotNull(), F.col("key")).when(F.col("near").isNotNull(), F.col("relative_key")))
    return out.withColumn("named", F.coalesce("direct", "near", F.lit(0))).drop("direct", "near", "relative_key")


def scoped(check):
    """Marks a check that takes (notes, of) and finds on the notes `of` alone, compared with all notes."""
    check.scoped = True
    return check


@scoped
def check_links(notes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Links that name no note, or several; link_paths has the paths of the latter.  One finding for each link, told apart by line and column."""
    of = notes if of is None else of
    if of is notes:
        of = notes = parsed_once(notes, "headings", "links")
    else:
        notes, of = parsed_once(notes, "headings"), M.extracted(of, "links")
    paths = materialised(link_paths(notes))
    d = _resolved(M.links(of), paths)
    broken = finding(d.where("named = 0"), "links", "error", F.concat(F.lit("Broken link: "), "original"), F.col("line"))
    many = d.where("named > 1").join(paths.withColumn("own", F.lit(1)), ["key", "path"], "left")
    others = F.col("named") - F.coalesce("own", F.lit(0))
    return broken.unionByName(finding(many, "links", "warning", F.concat(F.lit("Ambiguous link: "), "original"), F.col("line"), others, F.col("key")))


def _top_headings(notes: DataFrame) -> DataFrame:
    return M.headings(notes).where("depth = 1").withColumn("key", normal_key(F.col("text"))).withColumn("old", is_archived(F.col("path")))


def heading_paths(notes: DataFrame) -> DataFrame:
    """(key, path) of the notes outside the archive by their top headings."""
    return _top_headings(notes).where("not old").select("key", "path").distinct()


@scoped
def check_duplicate_headings(notes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Top headings that several notes outside the archive share, with the number of other notes; heading_paths has their paths."""
    all_ = parsed_once(notes, "headings")
    shared = heading_paths(all_).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    d = _top_headings(all_ if of is None else of).where("not old").join(shared, "key")
    return finding(d, "headings", "warning", F.concat(F.lit("Duplicate heading: "), "text"), F.col("line"), F.col("n") - 1, F.col("key"))


def archive_heading_paths(notes: DataFrame) -> DataFrame:
    """(key, path) of notes by their top headings; keys of notes in the archive begin with old:, of others with new:."""
    d = _top_headings(notes)
    return d.select(F.concat(F.when(F.col("old"), "old:").otherwise("new:"), "key").alias("key"), "path").distinct()


@scoped
def check_archive_headings(notes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Top headings that a note in use and one in the archive share, reported on both; archive_heading_paths has the other side's paths."""
    all_ = parsed_once(notes, "headings")
    counts = archive_heading_paths(all_).groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "other")
    d = _top_headings(all_ if of is None else of).withColumn("other", F.concat(F.when(F.col("old"), "new:").otherwise("old:"), "key")).join(counts, "other")
    return finding(d, "archive-headings", "error", F.concat(F.lit("Heading also in archive: "), "text"), F.col("line"), F.col("n"), F.col("other"))


def check_titles(notes: DataFrame) -> DataFrame:
    """First heading or frontmatter title that differs from the file's name; the heading of a source copy may differ.  A note's own row tells, so nothing is joined."""
    d = M.extracted(notes, "headings", "front")
    front = M.front_pairs(F.col("front_"))
    written = lambda k: V.text(V.Term(F.try_element_at(front, F.lit(k)), VariantType()))
    first = F.get(F.filter("headings_", lambda h: h["depth"] == 1), F.lit(0))
    d = held(d.select("path", "headings_", "front_"), first=first, title=written("title"), type=written("type")).withColumn("name", normal_key(title_of(F.col("path"))))
    heads = d.where("first is not null and coalesce(type, '') <> 'source-copy'").where(normal_key(F.col("first.text")) != F.col("name"))
    titles = d.where("title is not null").where(normal_key(F.col("title")) != F.col("name"))
    drift = finding(heads, "title-drift", "warning", F.concat(F.lit("Heading differs from file name: "), "first.text"), F.col("first.line"))
    return drift.unionByName(finding(titles, "title-drift", "warning", F.concat(F.lit("Title differs from file name: "), "title")))


def check_dump(notes: DataFrame) -> DataFrame:
    """Notes called dump.md whose text goes beyond frontmatter and headings; the first such line is reported."""
    d = M.parsed(notes.where(base_name(F.col("path")) == "dump.md"))
    under = F.transform(F.filter("rows", lambda r: r["kind"] == "u"), lambda r: r["part"])
    body = F.filter("rows", lambda r: ~r["kind"].isin("y", "b", "h") & ~F.array_contains(F.col("under"), r["part"]))
    first = held(held(d, under=under), first=F.array_min(F.transform(body, lambda r: r["line"]))).where("first is not null")
    return finding(first, "dump", "warning", F.lit("Dump note holds content"), F.col("first"))


def check_tasks(tasks: DataFrame) -> DataFrame:
    """All rules on single tasks, in one pass: each row makes an array of (severity, message), which is exploded."""
    rules: list[tuple[str, Column, Column]] = []

    def rule(severity: str, condition: Column, message: Column | str) -> None:
        rules.append((severity, F.coalesce(condition, F.lit(False)), F.lit(message) if isinstance(message, str) else message))

    f = lambda k: F.try_element_at("fields", F.lit(k))
    opened = ~F.col("done")
    for k in DATE_FIELDS:
        rule("error", f(k).isNotNull() & F.col(k).isNull(), F.concat(F.lit(f"Invalid {k} date: "), f(k)))
    rule("error", F.col("done") & F.col("completed").isNull(), "Done task without a completed date")
    rule("error", opened & f("completed").isNotNull(), "Open task with a completed date")
    for k in ("area", "project"):
        rule("error", opened & F.col(k).isNull(), f"Open task without {k}")
    status = repeat_status(F.col("repeat"))
    rule("warning", opened & F.col("due").isNull() & F.col("scheduled").isNull() & F.col("repeat").isNull(), "Open task without a date")
    rule("warning", opened & (F.col("scheduled") > F.col("due")), "Scheduled after due")
    for k in ("area", "project", "depends", "person", "source"):
        rule("warning", f(k).isNotNull() & ~is_wikilink(f(k)), F.concat(F.lit(f"{k} is no link: "), f(k)))
    rule("warning", f("priority").isNotNull() & ~F.lower(F.trim(f("priority"))).isin("high", "medium", "low"), F.concat(F.lit("Unknown priority: "), f("priority")))
    rule("error", status.isin("empty", "unsupported", "parse-error"), F.concat(F.lit("Unsupported repeat: "), F.col("repeat")))
    rule("warning", opened & (status == "supported") & F.col("due").isNull() & F.col("scheduled").isNull(), "Repeating task without a date")
    found = F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), m.alias("message"))) for s, c, m in rules])
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, ALLOWED_FIELDS)))), lambda k: F.struct(F.lit("warning").alias("severity"), F.concat(F.lit("Unknown field: "), k).alias("message")))
    # Rules are made by a projection, in generated code; the explosion alone has none to walk.
    d = kept(tasks, found_=F.concat(found, unknown)).select("path", "line", F.explode("found_").alias("x")).where(F.col("x").isNotNull())
    return d.select(F.lit("tasks").alias("category"), "x.severity", "path", F.col("line").cast("int").alias("line"), "x.message", F.lit(0).cast("long").alias("n_related"), F.lit(None).cast("string").alias("related_key"))


def recurring_series(tasks: DataFrame) -> DataFrame:
    """Tasks of a supported repeat with the key of their series, series_.

    Series are told apart by area, project, text, repeat, which of scheduled and due there are, and how far these lie apart; no area counts as an empty one.
    """
    d = tasks.where(repeat_status(F.col("repeat")) == "supported")
    shape = F.when(F.col("due").isNull(), "scheduled").when(F.col("scheduled").isNull(), "due").otherwise("scheduled+due")
    apart = F.coalesce(F.datediff(day_of(F.col("scheduled")), day_of(F.col("due"))), F.lit(0))
    parts = [F.coalesce("area", F.lit("")), F.coalesce("project", F.lit("")), F.col("text"), F.trim("repeat"), shape, apart.cast("string")]
    return d.withColumn("series_", F.sha2(F.concat_ws("\0", *parts), 256))


def check_repeat_seeds(tasks: DataFrame) -> DataFrame:
    """The latest completed task of a recurring series that no open task with a later date continues.

    A completed task's date is its due, scheduled or completed date, an open one's its due or scheduled date.  One aggregation gives the
    latest dates of each series, and only series that lack a continuation meet their tasks again.
    """
    opened = F.coalesce("due", "scheduled")
    dated = recurring_series(tasks).withColumn("date_", F.when(F.col("done"), F.coalesce(opened, "completed")).otherwise(opened))
    # Reading a note is dearer than writing its tasks, which are read twice.
    keyed = materialised(dated.select("path", "line", "text", "done", "date_", "series_"))
    last = keyed.groupBy("series_").agg(F.max(F.when(F.col("done"), F.col("date_"))).alias("done_"), F.max(F.when(~F.col("done"), F.col("date_"))).alias("open_"))
    late = last.where("done_ is not null and (open_ is null or open_ <= done_)")
    seeds = keyed.where("done").join(late, "series_").where("date_ = done_")
    return finding(seeds, "tasks", "warning", F.concat(F.lit("Repeating task has no later open task: "), "text"), F.col("line"))


#: Bundles of checks by name; each check takes notes and what they hold of tasks.
BUNDLES = {
    "links": ("links",),
    "headings": ("duplicate-headings", "titles", "archive-headings"),
    "tasks": ("tasks", "repeat-seeds"),
    "dump": ("dump",),
    "all": ("failures", "links", "duplicate-headings", "titles", "archive-headings", "dump", "tasks", "repeat-seeds"),
}
CHECKS: dict[str, Callable[..., DataFrame]] = {
    "failures": lambda notes: check_failures(notes),
    "links": check_links,
    "duplicate-headings": check_duplicate_headings,
    "titles": check_titles,
    "archive-headings": check_archive_headings,
    "dump": check_dump,
    "tasks": lambda notes: check_tasks(task_records(notes)),
    "repeat-seeds": lambda notes: check_repeat_seeds(task_records(notes)),
}


def check_failures(notes: DataFrame) -> DataFrame:
    """Notes that couldn't be read, each an error; see sources.vault.failures."""
    return finding(failures(notes), "catalog", "error", F.col("error"))


@dataclass(frozen=True)
class CheckSet:
    """Checks that run together; others can be added."""

    checks: tuple[Callable[..., DataFrame], ...]

    def add(self, check: Callable[..., DataFrame]) -> CheckSet:
        return replace(self, checks=(*self.checks, check))

    def run(self, notes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
        """Findings of all checks, on the paths of `chosen` alone where it is given: what a note is compared with stays the whole collection.

        Notes are parsed once for all checks.  With chosen paths, only the chosen notes are parsed for what findings are made of, and the
        others for what these are compared with; checks that aren't marked as scoped, but for those on single notes, see all notes, and what they find elsewhere goes.
        """
        sound, paths = readable(notes), None
        if chosen is not None:
            paths = chosen.select(F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("path")).distinct()
        near = (lambda d: d) if paths is None else lambda d: d.join(paths, "path", "left_semi")
        if paths is None:
            everything = own = materialised(M.extracted(sound))
        else:
            everything, own = materialised(M.extracted(sound, "headings")), materialised(M.extracted(near(sound)))
        found = finding(sound.where(F.lit(False)), "", "", F.lit(""))
        for check in self.checks:
            if check is CHECKS["failures"]:
                each = check(near(notes))
            elif getattr(check, "scoped", False):
                each = check(everything, own) if paths is not None else check(everything)
            elif check in SINGLE:
                each = check(own)
            else:
                each = near(check(everything))
            found = found.unionByName(each.select(*FINDING))
        return found


#: Checks whose findings depend on the note alone.
SINGLE = (CHECKS["titles"], CHECKS["dump"], CHECKS["tasks"])


def bundle(name: str = "all") -> CheckSet:
    return CheckSet(tuple(CHECKS[c] for c in BUNDLES[name]))


def categories(findings: DataFrame) -> DataFrame:
    """(category, n, ord): the categories of findings in their order of first appearance, with the number of findings in each."""
    place = F.min(F.struct("path", F.coalesce("line", F.lit(2**31 - 1)), "category"))
    per = findings.groupBy("category").agg(F.count("*").alias("n"), place.alias("first"))
    return per.select("category", "n", (F.row_number().over(Window.orderBy("first")) - 1).alias("ord"))


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", F.col("line").asc_nulls_last(), "category", "severity", "message")


def summary(findings: DataFrame, strict: bool = False) -> DataFrame:
    """(errors, warnings, failed): any error fails, with strict any warning too."""
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.withColumn("failed", (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)))
