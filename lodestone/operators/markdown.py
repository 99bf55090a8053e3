"""Records in Markdown notes: one DataFrame for each family, from notes (path, contents).

A note is parsed once, within its row (blocks.parsed); a family is an array of what its prose lines hold, found in masked text, so that code, HTML and
comments give no records and every record has its place.  No family needs a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import yaml
from ..functions.frames import held, kept
from ..functions.text import expanded_tags, let, matches, once, without
from . import blocks
from .blocks import HEADING  # noqa: F401

#: Fixed patterns of inline syntax.
LINK = r"!?\[\[[^\n\x00\x03]+?\]\](?!\])"
TAG = r"#[A-Za-z0-9/_-]+\b"
ANCHOR = r"(?<!\S)\^([A-Za-z0-9-]+)(?=$|\s)"
BARE_FIELD = r"^([^\[\]\n]+?)::[ \t]*(.*)$"
BLOCK_ID = r"^[A-Za-z0-9-]+$"
#: Code as a whole in its first group, for replacements that keep it.
CODE = r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"
KEPT_CODE = r"((?<!`)(`+)(?!`)(?s:.*?)(?<!`)\2(?!`))"
#: What decides where fields begin and end: links as a whole, brackets, double colons, line ends.
_FIELD_MARKS = r"\[\[(?:(?!\]\])[^\n])*\]\]|::|[\[\]()\n]"
#: A field without brackets but its links', with its key and its value, trimmed; where no other bracket is left, these are all fields.
_PLAIN_PAIR = r" *+(?=\s*+[^\[\]()\n:\s])((?:[^\[\]()\n: ]++| ++(?!:))*+) *+:: *+((?:\[\[[^\[\]\n]*\]\]|[^\[\]()\n ]++| ++(?![\])]))*+) *+"
_PLAIN_FIELD = rf"(?=[\[(])(?:\[{_PLAIN_PAIR}\]|\({_PLAIN_PAIR}\))"
#: A link with colons or brackets of its own, which aren't a field's, so that marks need counting.
_FULL_LINK = r"\[\[[^\]\n]*(?:::|[()])"
#: What makes a note, after a line end, need the fold over its lines: marks of code, HTML and escapes, tabs, and lines that are neither blank, nor headings, text or items right at their beginning.
HARD = r"[`<\\\t\r\x00\x01\x02\x03\n](?<!\n(?=\n|\z|#{1,6} [^\n]|(?:[-*+] )?" + blocks.PLAIN[1:] + "))"
PLAIN_BOX = r"^[-*+] \[[ xX]\]\s+"
_SPAN = "struct<start:int,end:int,key_start:int,key_end:int,value_start:int,value_end:int>"


@once
def _prose() -> Column:
    def line(r):
        first = r["line"] == r["part"]
        mine = F.get(F.split(F.get("mask", r["group"]), "\n", -1), r["line"] - r["part"])
        return F.struct(
            r["line"].alias("line"), r["kind"].alias("kind"), r["text"].alias("text"), mine.alias("masked"), r["at"].alias("at"), r["col"].alias("col"), r["item"].alias("item"), r["part"].alias("part"),
            F.when(first, F.get("shown", r["group"])).alias("whole"), F.when(first, F.get("mask", r["group"])).alias("whole_mask"), let(mine, field_spans).alias("spans"),
        )

    return F.transform(F.filter("rows", lambda r: r["kind"].isin(*blocks.PROSE)), line)


def parsed(notes: DataFrame, *keep: str) -> DataFrame:
    """What blocks.parsed gives, and prose: array<struct<line, kind, text, masked, at, col, item, part, whole, whole_mask, spans>> of the lines with running text or headings.

    masked is the line's part of its paragraph's masked text; whole and whole_mask are the paragraph's, in its first line alone; spans are the line's fields.
    """
    d = blocks.parsed(notes, *keep)
    return held(d, prose=_prose())


def _each(array: Column, of) -> Column:
    return F.flatten(F.transform(array, of))


def _holding(mark: str) -> Column:
    return F.filter("prose", lambda r: F.contains(r["masked"], F.lit(mark)))


def _notes_with(notes: DataFrame, mark: str) -> DataFrame:
    """notes that hold a mark.  Their contents are kept, or the optimiser would make them, and look for marks, before a table is spread, and again after that."""
    return kept(notes.withColumnRenamed("contents", "written_"), contents=F.col("written_")).select(*notes.columns).where(F.contains("contents", F.lit(mark)))


def _exploded(d: DataFrame, records: Column | str) -> DataFrame:
    return d.select("path", F.explode(records).alias("r_")).select("path", "r_.*")


#: Families that can be extracted together: the column that holds each, its records, and the text that notes with any of them hold.
FAMILIES = {
    "headings": ("headings_", lambda: heading_records(), ""),
    "links": ("links_", lambda: link_records(), "[["),
    "tags": ("tags_", lambda: tag_records(), "#"),
    "fields": ("fields_", lambda: field_records(), "::"),
    "tasks": ("tasks_", lambda: task_records(), "#task"),
    "front": ("front_", lambda: front_json(), ""),
}


def extracted(notes: DataFrame, *families: str) -> DataFrame:
    """notes with the records of some families (all of FAMILIES where none is named) in a column each, from one parse of each note.

    The functions of these families take such notes like others and parse nothing then.  Materialise them where several are to follow.
    """
    wanted = [f for f in families or FAMILIES if FAMILIES[f][0] not in notes.columns]
    if not wanted:
        return notes
    d = parsed(notes, *[c for c in notes.columns if c != "path"])
    return held(d, **{FAMILIES[f][0]: FAMILIES[f][1]() for f in wanted}).select(*notes.columns, *[FAMILIES[f][0] for f in wanted])


def _family(notes: DataFrame, name: str) -> DataFrame:
    column, records, mark = FAMILIES[name]
    return _exploded(notes, column) if column in notes.columns else _exploded(parsed(_notes_with(notes, mark) if mark else notes), records())


def body_lines(notes: DataFrame, holding: str = "") -> DataFrame:
    """(path, line, text) of the lines after the frontmatter that hold a text, those inside code too, as they are written."""
    contents = F.coalesce(F.col("contents"), F.lit(""))
    d = notes.where(F.contains("contents", F.lit(holding))) if holding else notes
    d = d.select("path", F.split(contents, r"\r?\n").alias("lines"), contents.startswith("---").alias("marked"))
    d = d.select("path", F.when(F.col("marked"), blocks.front_lines(F.col("lines"))).otherwise(0).alias("front"), F.posexplode("lines").alias("i", "text")).where(F.col("i") >= F.col("front"))
    return (d.where(F.contains("text", F.lit(holding))) if holding else d).select("path", (F.col("i") + 1).alias("line"), "text")


# Inline fields: brackets are matched by their running depth.


def field_spans(masked: Column) -> Column:
    """array<struct<start, end, key_start, key_end, value_start, value_end>> of the inline fields in masked text, ends exclusive.

    A field opens at a bracket that double colons follow before it closes, and ends where the depth of its own kind of bracket, counted over the marks
    of the text, falls below that at the colons.  One that holds another is text, and so is the other.
    """

    def spans(t):
        n = F.size(t)
        upto = lambda a, b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.size(F.filter(F.slice(t, F.lit(1), i + 1), lambda m: m["value"] == a)) - F.size(F.filter(F.slice(t, F.lit(1), i + 1), lambda m: m["value"] == b)))
        return let(F.struct(upto("[", "]").alias("square"), upto("(", ")").alias("round")), lambda depth: found(t, n, depth))

    def found(t, n, depth):
        value = lambda i: F.get(t, i)["value"]
        start = lambda i: F.get(t, i)["start"]

        def one(i):
            square = value(i) == "["
            close = F.when(square, "]").otherwise(")")
            later = F.sequence(i + 1, n - 1)
            colons = F.get(F.filter(later, lambda j: value(j).isin("::", "\n") | (value(j) == close)), F.lit(0))
            at = lambda j: F.when(square, F.get(depth["square"], j)).otherwise(F.get(depth["round"], j))

            def ended(c):
                end = F.get(F.filter(F.sequence(c, n - 1), lambda j: (value(j) == "\n") | ((value(j) == close) & (at(j) < at(c)))), F.lit(0))
                return let(end, lambda e: F.when((value(c) == "::") & (value(e) == close), bounds(i, c, e)))

            return F.when((i < n - 1) & colons.isNotNull(), let(colons, ended))

        def bounds(i, c, e):
            return F.struct(start(i).alias("start"), (start(e) + 1).alias("end"), (start(i) + 1).alias("key_start"), start(c).alias("key_end"), (start(c) + 2).alias("value_start"), start(e).alias("value_end"))

        opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: value(i).isin("[", "("))
        return F.filter(F.transform(opens, one), lambda s: s.isNotNull() & (F.trim(F.translate(F.substring(masked, s["key_start"] + 1, s["key_end"] - s["key_start"]), "\t", " ")) != ""))

    def outermost(all_):
        free = F.aggregate(
            all_, F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{_SPAN}>").alias("out")),
            lambda a, s: F.when(s["start"] >= a["next"], F.struct(s["end"].alias("next"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a), lambda a: a["out"],
        )
        inside = lambda o, s: (o["start"] > s["start"]) & (((o["start"] >= s["key_start"]) & (o["end"] <= s["key_end"])) | ((o["start"] >= s["value_start"]) & (o["end"] <= s["value_end"])))
        return F.filter(free, lambda s: ~F.exists(all_, lambda o: inside(o, s)))

    def plain(m):
        colons = m["start"] + F.locate("::", m["value"]) - 1
        end = m["start"] + F.length(m["value"])
        return F.struct(m["start"].alias("start"), end.alias("end"), (m["start"] + 1).alias("key_start"), colons.alias("key_end"), (colons + 2).alias("value_start"), (end - 1).alias("value_end"))

    none = F.array().cast(f"array<{_SPAN}>")
    whole = let(matches(masked, _FIELD_MARKS), lambda t: F.when(F.size(t) > 2, let(spans(t), outermost)).otherwise(none))
    simple = ~F.regexp_replace(masked, rf"{_PLAIN_FIELD}|\[\[[^\[\]\n]*\]\]", "").rlike(r"[\[\]()]") & ~masked.rlike(_FULL_LINK)
    found = F.when(simple, F.transform(matches(masked, _PLAIN_FIELD), plain)).otherwise(F.coalesce(whole, none))
    return F.when(F.contains(masked, F.lit("::")), found).otherwise(none)


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.trim(F.translate(F.substring(text, start + 1, end - start), "\t", " "))


def _fields(r: Column) -> Column:
    """The fields of a prose line, in their order."""
    return F.transform(
        r["spans"],
        lambda s, i: F.struct(
            r["line"].alias("line"), i.alias("ord"), (r["at"] + s["start"] + 1).alias("column"),
            _cut(r["text"], s["key_start"], s["key_end"]).alias("key"), _cut(r["text"], s["value_start"], s["value_end"]).alias("value"),
        ),
    )


def shown_text(text: Column, mask: Column | None = None) -> Column:
    """What a paragraph shows: fields by their value, links by their alias or target, code spans and marked text without marks, no images."""
    mask = blocks.masked(text) if mask is None else mask
    text = F.when(F.contains(mask, F.lit("::")), let(field_spans(mask), lambda spans: without(text, spans, lambda s: _cut(text, s["value_start"], s["value_end"])))).otherwise(text)
    return let(text, _unmarked)


def _unmarked(text: Column) -> Column:
    """text without the marks of code, emphasis and links; texts without such characters are left at one look."""
    bare = F.regexp_replace(text, KEPT_CODE + r"|(\*\*|__|~~)(?=\S)((?s:.+?))(?<=\S)\3|(?<![\w*])([*_])(?=[^\s*_])([^*_]+?)(?<=\S)\5(?![\w*])", "$1$4$6")
    links = r"!?\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|!\[[^\[\]]*\]\([^()]*\)|\[([^\[\]]*)\]\([^()]*\)"
    shown = lambda t: F.regexp_replace(t, r"(?<!`)(`+)(?!`)((?s:.*?))(?<!`)\1(?!`)|" + links, "$2$3$4")
    return F.trim(F.when(text.rlike(r"[`*_~]"), let(bare, shown)).when(F.contains(text, F.lit("[")), shown(text)).otherwise(text))


# Frontmatter.


@once
def front_json() -> Column:
    """The frontmatter of a parsed note as JSON; null where there is none, or it holds no map."""
    return F.when(F.col("front") > 2, yaml.block_json(F.slice("lines", F.lit(2), F.greatest(F.col("front") - 2, F.lit(0)))))


def frontmatter_json(notes: DataFrame, *keep: str) -> DataFrame:
    """(path, kept columns, front, json): how many lines are frontmatter, and what it holds, as JSON (null where it holds no map or can't be read)."""
    contents = F.coalesce(F.col("contents"), F.lit(""))
    d = notes.select("path", *keep, F.when(contents.startswith("---"), F.split(contents, r"\r?\n")).alias("lines"))
    d = d.withColumn("front", F.when(F.col("lines").isNotNull(), blocks.front_lines(F.col("lines"))).otherwise(0))
    return d.select("path", *keep, "front", front_json().alias("json"))


def front_pairs(json: Column) -> Column:
    """map<string, variant> of frontmatter's JSON, keys in their order."""
    return F.from_json(json, "map<string,variant>")


def frontmatter_values(notes: DataFrame) -> DataFrame:
    """(path, ord, key, value) of each note's frontmatter; value is a VARIANT of YAML's core types, with nested lists and maps."""
    if "front_" not in notes.columns:
        notes = frontmatter_json(notes.where(F.col("contents").startswith("---"))).withColumnRenamed("json", "front_")
    return notes.select("path", F.posexplode(front_pairs(F.col("front_"))).alias("ord", "key", "value"))


def frontmatter(notes: DataFrame) -> DataFrame:
    """(path, ord, key, value) of the top-level keys whose value is on their line; values as written, quotes removed.  frontmatter_values reads them all, with types."""
    contents = F.coalesce(F.col("contents"), F.lit(""))
    d = notes.where(F.col("contents").startswith("---")).select("path", F.split(contents, r"\r?\n").alias("lines"))
    rows = d.select("path", F.posexplode(F.slice("lines", F.lit(2), F.greatest(blocks.front_lines(F.col("lines")) - 2, F.lit(0)))).alias("ord", "text"))
    rx = r"^([^\s:#-][^:]*):(?:\s+(.*?))?\s*$"
    value = F.regexp_replace(F.regexp_extract("text", rx, 2), r"^(['\"])(.*)\1$", "$2")
    return rows.where(F.col("text").rlike(rx)).select("path", "ord", F.regexp_extract("text", rx, 1).alias("key"), F.nullif(value, F.lit("")).alias("value"))


def front_tags(json: Column) -> Column:
    """Tags that frontmatter names, each with its mark: of a text or a list of texts."""
    v = F.try_element_at(front_pairs(json), F.lit("tags"))
    several = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    texts = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(several, lambda x: F.try_variant_get(x, "$", "string"))).when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    named = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(named, lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))


# Headings.


@once
def heading_records() -> Column:
    """The headings of a parsed note: array<struct<line, depth, text, source>>."""

    def marked(r):
        inner = F.regexp_extract(r["text"], HEADING, 2)
        return F.struct(r["line"].alias("line"), F.length(F.regexp_extract(r["text"], HEADING, 1)).alias("depth"), shown_text(inner).alias("text"), r["text"].alias("source"))

    def underlined(u):
        first = F.get("rows", u["part"] - 1)
        depth = F.when(F.ltrim(u["text"]).startswith("="), 1).otherwise(2)
        return F.struct(u["part"].alias("line"), depth.alias("depth"), shown_text(F.regexp_replace(F.get("shown", u["group"]), r"\n$", "")).alias("text"), first["text"].alias("source"))

    plain = F.transform(F.filter("prose", lambda r: r["kind"] == "h"), marked)
    under = F.filter("rows", lambda r: r["kind"] == "u")
    return F.when(F.size(under) == 0, plain).otherwise(F.array_sort(F.concat(plain, F.transform(under, underlined))))


def headings(notes: DataFrame) -> DataFrame:
    """(path, line, depth, text, source) of headings with # marks or underlines, in quotes and items too; source is the first line as it is written."""
    return _family(notes, "headings")


def table_of_contents(notes: DataFrame) -> DataFrame:
    """Headings with the line of the nearest earlier one of smaller depth as parent (null at the top)."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    d = headings(notes)
    for depth in range(1, 6):
        d = d.withColumn(f"at{depth}", F.max(F.when(F.col("depth") == depth, F.col("line"))).over(w))
    shallower = [F.when(F.col("depth") > k, F.col(f"at{k}")) for k in range(1, 6)]
    return d.select("path", "line", "depth", "text", F.greatest(*shallower).alias("parent"))


# Links, tags, fields, anchors.

#: The part of a link before a mark outside brackets within it.
_UPTO = r"^((?:[^\[\]{0}]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*){0}(?s:(.*))$"


def _split_at(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first mark that is in no brackets; all and null where there is none."""
    rx = _UPTO.format(re.escape(mark))
    held = text.rlike(rx)
    return F.when(held, F.regexp_extract(text, rx, 1)).otherwise(text), F.when(held, F.regexp_extract(text, rx, 2))


@once
def link_records() -> Column:
    """The links of a parsed note: array<struct<line, ord, column, original, embed, target, header, block, alias, value>>."""

    def apart(r):
        """The masked line with the marks of its fields blanked, so that a link in a field ends where the field does."""
        cut = lambda a, b: F.substring(r["masked"], a + 1, b - a)
        mark = F.lit("\x03")
        kept = lambda s: F.concat(mark, cut(s["key_start"], s["key_end"]), mark, mark, cut(s["value_start"], s["value_end"]), mark)
        return F.when(F.size(r["spans"]) > 0, without(r["masked"], r["spans"], kept)).otherwise(r["masked"])

    def of(r):
        found = let(apart(r), lambda t: F.transform(matches(t, LINK), lambda m, i: one(r, m, i)))
        return F.filter(found, lambda x: x.isNotNull())

    def one(r, m, i):
        original = F.translate(m["value"], "\x02", "")
        inner = F.regexp_replace(original, r"^!?\[\[|\]\]$", "")
        body, alias = _split_at(inner, "|")
        return let(F.struct(original.alias("original"), body.alias("body"), F.nullif(F.trim(alias), F.lit("")).alias("alias")), lambda p: made(r, m, i, p))

    def made(r, m, i, p):
        target, fragment = (F.trim(c) for c in _split_at(p["body"], "#"))
        block = F.when(fragment.startswith("^"), F.trim(F.substring(fragment, F.lit(2), F.length(fragment))))
        header = F.when(~fragment.startswith("^"), fragment)
        sound = ~target.startswith("^^") & ((target != "") | fragment.isNotNull()) & F.coalesce((fragment != "") & ~fragment.startswith("#") & (block.isNull() | block.rlike(BLOCK_ID)), F.lit(True))
        value = F.coalesce(p["alias"], F.nullif(target, F.lit("")), header, block)
        return F.when(
            sound,
            F.struct(
                r["line"].alias("line"), i.alias("ord"), (r["at"] + m["start"] + 1).alias("column"), p["original"].alias("original"), p["original"].startswith("!").alias("embed"), target.alias("target"),
                header.alias("header"), block.alias("block"), p["alias"].alias("alias"), value.alias("value"),
            ),
        )

    return _each(_holding("[["), of)


def links(notes: DataFrame) -> DataFrame:
    """(path, line, ord, column, original, embed, target, header, block, alias, value) of wikilinks; parts that are absent are null.  column counts from 1 in the line as it is written."""
    return _family(notes, "links")


def line_tags(masked: Column, spans: Column) -> Column:
    """array<struct<start, value>> of the tags in masked text, outside fields and links."""
    open_ = F.when(F.size(spans) > 0, without(masked, spans, lambda s: F.repeat(F.lit("\x00"), s["end"] - s["start"]))).otherwise(masked)
    return let(open_, lambda t: F.filter(matches(t, f"{LINK}|{TAG}"), lambda m: m["value"].startswith("#")))


@once
def tag_records() -> Column:
    """The tags of a parsed note: array<struct<line, ord, column, value>>."""
    return _each(
        _holding("#"),
        lambda r: F.transform(line_tags(r["masked"], r["spans"]), lambda m, i: F.struct(r["line"].alias("line"), i.alias("ord"), (r["at"] + m["start"] + 1).alias("column"), m["value"].alias("value"))),
    )


def tags(notes: DataFrame) -> DataFrame:
    """(path, line, ord, column, value) of tags in running text."""
    return _family(notes, "tags")


def note_tags(notes: DataFrame) -> DataFrame:
    """(path, etags, tags): frontmatter and body tags once each, and with the tags above them in their hierarchy."""
    d = extracted(notes, "front", "tags").select("path", F.concat(front_tags(F.col("front_")), F.transform("tags_", lambda t: t["value"])).alias("found"))
    d = d.select("path", F.array_distinct("found").alias("etags")).where(F.size("etags") > 0)
    return d.select("path", "etags", expanded_tags(F.col("etags")).alias("tags"))


@once
def field_records() -> Column:
    """The inline fields of a parsed note: array<struct<line, ord, column, key, value>>."""
    return _each(_holding("::"), _fields)


def inline_fields(notes: DataFrame) -> DataFrame:
    """(path, line, ord, column, key, value) of [key:: value] and (key:: value)."""
    return _family(notes, "fields")


@once
def bare_records() -> Column:
    """The 'key:: value' lines of a parsed note: array<struct<line, key, value>>."""
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("text")))
    own = F.filter(each, lambda r: (r["line"] > F.col("front")) & F.contains(r["text"], F.lit("::")) & r["text"].rlike(BARE_FIELD))
    made = F.transform(own, lambda r: F.struct(r["line"].alias("line"), *[F.trim(F.regexp_extract(r["text"], BARE_FIELD, n)).alias(c) for n, c in ((1, "key"), (2, "value"))]))
    return F.filter(made, lambda r: r["key"] != "")


def bare_fields(notes: DataFrame) -> DataFrame:
    """(path, line, key, value) of 'key:: value' lines after the frontmatter, those inside code too; keys with brackets don't count."""
    key, value = (F.trim(F.regexp_extract("text", BARE_FIELD, n)) for n in (1, 2))
    rows = body_lines(notes, "::").withColumn("text", F.trim("text"))
    return rows.where(F.col("text").rlike(BARE_FIELD)).select("path", "line", key.alias("key"), value.alias("value")).where("key <> ''")


def block_anchors(notes: DataFrame) -> DataFrame:
    """(path, line, column, id) of ^anchors."""
    made = lambda r: F.transform(matches(r["masked"], ANCHOR), lambda m: F.struct(r["line"].alias("line"), (r["at"] + m["start"] + 1).alias("column"), F.substring(m["value"], F.lit(2), F.length(m["value"])).alias("id")))
    return _exploded(parsed(_notes_with(notes, "^")), _each(_holding("^"), made))


# Items and code.


def _source(r: Column) -> tuple[Column, Column, Column]:
    """Of an item's line: whether it is checked (null without a box), how long its box is, and what follows that."""
    mark, n = F.regexp_extract(r["text"], blocks.BOX, 1), F.length(F.regexp_extract(r["text"], blocks.BOX, 0))
    return F.when(mark != "", mark != " "), n, F.substring(r["text"], n + 1, F.length(r["text"]))


@once
def item_records(holding: str = "") -> Column:
    """The list items of a parsed note: array<struct<line, indent, checked, text, source>>.

    text is the first line of what the item's own paragraph shows, so marked text may go on in the next line; source is the item's line as it is written.
    """

    def made(r):
        checked, n, source = _source(r)
        rest = lambda c: F.substring(c, n + 1, F.length(c))
        whole = F.struct(rest(F.coalesce(r["whole"], r["text"])).alias("text"), rest(F.coalesce(r["whole_mask"], r["masked"])).alias("mask"))
        shown = let(whole, lambda w: F.substring_index(shown_text(w["text"], w["mask"]), "\n", 1))
        return F.struct(r["line"].alias("line"), r["col"].alias("indent"), checked.alias("checked"), F.trim(shown).alias("text"), source.alias("source"))

    own = F.filter("prose", lambda r: r["item"] & F.contains(r["text"], F.lit(holding))) if holding else F.filter("prose", lambda r: r["item"])
    empty = F.transform(
        F.filter("rows", lambda r: r["item"] & (r["kind"] == "b")), lambda r: F.struct(r["line"].alias("line"), r["col"].alias("indent"), F.lit(None).cast("boolean").alias("checked"), F.lit("").alias("text"), F.lit("").alias("source"))
    )
    found = F.transform(own, made)
    return found if holding else F.concat(found, empty)


@once
def task_records() -> Column:
    """The items of a parsed note with a box and a tag #task: array<struct<line, checked, source, tags, spans>>; spans are the places of the fields in source."""

    def made(r):
        checked, n, source = _source(r)
        spans = F.transform(r["spans"], lambda s: F.struct(*[(s[c] - n).alias(c) for c in ("start", "end", "key_start", "key_end", "value_start", "value_end")]))
        tags_ = F.transform(line_tags(r["masked"], r["spans"]), lambda m: m["value"])
        return F.struct(r["line"].alias("line"), checked.alias("checked"), source.alias("source"), tags_.alias("tags"), spans.alias("spans"))

    boxed = F.filter("prose", lambda r: r["item"] & F.contains(r["text"], F.lit("#task")) & r["text"].rlike(blocks.BOX))
    return F.filter(F.transform(boxed, made), lambda t: F.array_contains(t["tags"], "#task"))


def task_items(notes: DataFrame) -> DataFrame:
    """(path, line, checked, source, tags, spans, free, keys, values) of items with a box and a tag #task.

    free is source without its fields, whose keys and values are arrays; where brackets aren't that plain these are null, and spans has the places of the fields.
    Notes of plain lines alone need no fold: each of their items stands for itself.  Others are parsed.  Both read notes, which must give the same rows each time.
    """
    parsed_ = lambda d: _family(d, "tasks").selectExpr("*", "CAST(NULL AS string) AS free", *[f"CAST(NULL AS array<string>) AS {c}" for c in ("keys", "values")])
    if FAMILIES["tasks"][0] in notes.columns:
        return parsed_(notes)
    marked = _notes_with(notes, "#task")
    hard = F.concat(F.lit("\n"), "contents").rlike(HARD)
    return _plain_tasks(marked.where(~hard)).unionByName(parsed_(marked.where(hard)))


def _plain_tasks(notes: DataFrame) -> DataFrame:
    d = notes.select("path", F.posexplode(F.split("contents", "\n")).alias("i", "text_")).where(F.contains("text_", F.lit("#task")) & F.col("text_").rlike(PLAIN_BOX))
    source = F.regexp_replace("text_", PLAIN_BOX, "")
    d = d.select("path", (F.col("i") + 1).alias("line"), (F.substring("text_", 4, 1) != " ").alias("checked"), source.alias("source"))
    # One look finds the fields and writes them between marks that no plain note holds; what follows looks for these.
    d = d.withColumn("marked_", F.regexp_replace("source", _PLAIN_FIELD, "\x00$1$3\x01$2$4\x00"))
    d = d.withColumn("open_", F.regexp_replace("marked_", r"\x00[^\x00]*+\x00", "\x00"))
    bracketed = F.col("open_").rlike(r"[\[\]()]") & F.regexp_replace("open_", r"\[\[[^\[\]\n]*\]\]", "").rlike(r"[\[\]()]")
    d = d.withColumn("spans", F.when(bracketed | F.col("source").rlike(_FULL_LINK), field_spans(F.col("source"))))
    tags_ = F.array_remove(F.regexp_extract_all("open_", F.lit(f"(?=[!\\[#])(?:{LINK}|({TAG}))"), F.lit(1)), "")
    bent = F.transform(line_tags(F.col("source"), F.col("spans")), lambda m: m["value"])
    d = kept(d, tags=F.when(F.col("spans").isNull(), tags_).otherwise(bent)).where(F.array_contains("tags", "#task"))
    flat = lambda c: F.when(F.col("spans").isNull(), c)
    pairs = {name: flat(F.regexp_extract_all("marked_", F.lit(rx), F.lit(1))) for name, rx in (("keys", r"\x00([^\x00\x01]*+)\x01"), ("values", r"\x01([^\x00]*+)\x00"))}
    return d.select("path", "line", "checked", "source", "tags", "spans", flat(F.replace("open_", F.lit("\x00"), F.lit(""))).alias("free"), *[c.alias(name) for name, c in pairs.items()])


def list_items(notes: DataFrame, holding: str = "") -> DataFrame:
    """(path, line, indent, checked, text, source): checked is null for plain bullets, text is what the first line shows, source as it is written.  Items in quotes and items count."""
    return _exploded(parsed(_notes_with(notes, holding) if holding else notes), item_records(holding))


@once
def code_records(fenced: bool = True) -> Column:
    """array<struct<line, info, value>> of the fenced, or the indented, code of a parsed note; info is null for the latter."""
    heads = F.filter("rows", lambda r: (r["kind"] == "o") if fenced else (r["kind"] == "d") & (r["line"] == r["part"]))

    def made(h):
        of = F.filter("rows", lambda r: (r["part"] == h["part"]) & (r["kind"] == "f" if fenced else r["kind"].isin("d", "b")))
        lead = F.length(F.regexp_extract(h["text"], r"^ *", 0))
        texts = F.transform(of, lambda r: F.regexp_replace(r["text"], F.concat(F.lit("^ {0,"), lead.cast("string"), F.lit("}")), "") if fenced else F.regexp_replace(r["text"], r"^(?: {1,4}| {0,3}\t)", ""))
        value = F.array_join(texts, "\n") if fenced else F.regexp_replace(F.array_join(texts, "\n"), r"\s+$", "")
        info = F.trim(F.regexp_extract(h["text"], blocks.FENCE, 2)) if fenced else F.lit(None).cast("string")
        return F.struct(h["line"].alias("line"), info.alias("info"), value.alias("value"))

    return F.transform(heads, made)


def _with_words(d: DataFrame) -> DataFrame:
    word, rest = F.substring_index("info", " ", 1), F.trim(F.expr("substring(info, length(substring_index(info, ' ', 1)) + 1)"))
    return d.select("path", "line", F.nullif(word, F.lit("")).alias("language"), F.nullif(rest, F.lit("")).alias("meta"), "value")


def fenced_blocks(notes: DataFrame) -> DataFrame:
    """(path, line, language, meta, value) of fenced code, in quotes and items too."""
    return _with_words(_exploded(parsed(notes), code_records()))


def code_blocks(notes: DataFrame) -> DataFrame:
    """(path, line, language, meta, value) of fenced and indented code; indented code has neither language nor meta."""
    return _with_words(_exploded(parsed(notes), F.concat(code_records(), code_records(False))))


def renamed_links(notes: DataFrame, old: str, new: str) -> DataFrame:
    """notes with every link to old pointing to new; fragments, aliases, frontmatter, HTML and code stay as they are."""
    rx = rf"(!?\[\[)\s*{re.escape(old)}\s*(?=[#|\]])"
    to = "$1" + new.replace("\\", r"\\").replace("$", r"\$")

    def edited(line):
        parts = F.regexp_extract_all(line, F.lit(CODE + r"|[^`]+|`+"), F.lit(0))
        return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("`"), x).otherwise(F.regexp_replace(x, rx, to))), "")

    d = blocks.parsed(notes, *[c for c in notes.columns if c != "path"])
    lines = F.transform(F.split("contents", "\n"), lambda x, i: F.when(F.get("rows", i)["kind"].isin(*blocks.PROSE), edited(x)).otherwise(x))
    new = F.when(F.col("contents").rlike(rx), F.array_join(lines, "\n")).otherwise(F.col("contents"))
    # Made by a generator, the new contents stay one column to the optimiser, however often what follows names them.
    return d.select(*[c for c in notes.columns if c != "contents"], F.explode(F.array(new)).alias("contents")).select(*notes.columns)
