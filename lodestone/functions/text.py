"""Text and date helpers of notes, as column expressions."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(make):
    """make, whose large expression of columns by name is built once for each JVM: building is slower than most plans."""
    made: dict = {}

    @functools.wraps(make)
    def kept(*args):
        key = (id(SparkContext._jvm), *args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return kept


def normal_key(value: Column) -> Column:
    """What links, titles and paths are matched by: cut at the first '#', trimmed, lower case, without '.md'."""
    return F.regexp_replace(F.lower(F.trim(F.substring_index(value, "#", 1))), r"\.md$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title_of(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.md$", "")


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def is_archived(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("90-Archive"), F.lit("Archive")))


def sanitised_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(key)), r"\s+", "-")


def is_wikilink(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(r"^\[\[.*\]\]$"), F.lit(False))


def day_of(value: Column) -> Column:
    """The date that a YYYY-MM-DD text names, else null.  A cast, since a parser by pattern throws, and is slow, at each invalid day."""
    return F.when(value.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}\z"), value.try_cast("date"))


def iso_date(value: Column) -> Column:
    """A valid YYYY-MM-DD text, else null."""
    return F.when(day_of(value).isNotNull(), value)


def expanded_tags(tags: Column) -> Column:
    """'#a/b/c' also counts as '#a' and '#a/b'; each tag once, in order of first appearance."""

    def prefixes(tag):
        parts = F.split(tag, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    return F.array_distinct(F.flatten(F.transform(tags, prefixes)))


def resolved_path(folder: Column, target: Column) -> Column:
    """target against folder, with '.' and '..' worked off; null where it leaves the root."""
    steps = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda s: (s != "") & (s != "."))
    out = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)),
    )
    return F.array_join(out, "/")


def source_line(contents: Column, line: Column) -> Column:
    """The 1-based line of a text; null beyond its end."""
    return F.try_element_at(F.split(contents, "\n"), line.cast("int"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of a pattern's matches, with the 0-based place of each: the lengths of what lies between the matches, and of themselves, add up to it."""
    rx = F.lit(pattern)

    def placed(found):
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
        return F.aggregate(
            steps, start,
            lambda a, s: F.struct((a["at"] + s["gap"] + F.length(s["value"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), s["value"].alias("value")))).alias("out")),
            lambda a: a["out"],
        )

    return let(F.regexp_extract_all(text, rx, F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast("array<struct<start:int,value:string>>")).otherwise(placed(found)))


def without(text: Column, spans: Column, by) -> Column:
    """text with spans (structs with 0-based start and end, in order, apart from one another) replaced by by(span)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), by(s)).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
