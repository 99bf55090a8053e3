"""Typed values of YAML, as column expressions: block maps and lists by a fold over their lines, flow lists and maps, quoted, literal and folded text.

What is read is what notes begin with: one map, whose scalars have the types of YAML 1.2's core schema.  Values are JSON text,
from which VARIANT columns are made.  Anchors, aliases and explicit types are read as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"
#: A key, its colon, and the rest of the line.
KEY = rf"^({_QUOTED}|(?:[^\s\"'\[\]{{}},#&*!|>%@`?:-]|[?:-](?=\S)).*?)\s*:(?:\s+(.*?))?\s*$"
#: What heads literal and folded text: its style, and what becomes of line ends at its end.
TEXT_HEAD = r"^([|>])(?:\d?([+-])?|([+-])\d)$"
COMMENT = rf"^((?:{_QUOTED}|(?!\s#).)*+)\s#.*$"
#: Marks and scalars of a flow list or map.
FLOW = rf"{_QUOTED}|[\[\]{{}},]|:(?=[\s\[\]{{}},\"']|$)|(?:[^\[\]{{}},:\"'\s]|:(?![\s\[\]{{}},\"']|$))(?:[^\[\]{{}},:]|:(?![\s\[\]{{}},]|$))*"

#: Stands where JSON can't be made, as for an open quote, so that what holds it is none.
UNREADABLE = "!"

_STACK = "array<struct<col:int,kind:string>>"
_TEXT = "struct<style:string,keep:string,col:int>"


def json_text(x: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(x))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def plain_json(x: Column) -> Column:
    """A plain or quoted scalar as JSON, by the core schema; an empty one is null.  Infinities and not-a-number, which JSON lacks, are text."""
    inner = F.substring(x, F.lit(2), F.length(x) - 2)
    escaped = F.regexp_replace(F.regexp_replace(x, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1"), r"\\([ /])", "$1")
    number = lambda of: F.coalesce(of.try_cast("decimal(38,0)").cast("string"), of.try_cast("double").cast("string"))
    return (
        F.when(x.rlike(r"^(?:~|null|Null|NULL)?$"), "null")
        .when(x.rlike(r"^(?:true|True|TRUE|false|False|FALSE)$"), F.lower(x))
        .when(x.rlike(r"^[-+]?[0-9]+$"), number(x))
        .when(x.rlike(r"^0o[0-7]+$"), F.conv(F.substring(x, 3, 64), 8, 10))
        .when(x.rlike(r"^0x[0-9a-fA-F]+$"), F.conv(F.substring(x, 3, 64), 16, 10))
        .when(x.rlike(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$"), F.coalesce(F.to_json(F.array(x.try_cast("double"))).substr(F.lit(2), F.length(F.to_json(F.array(x.try_cast("double")))) - 2), json_text(x)))
        .when(x.rlike(r'^"(?s:.*)"$'), F.when(F.is_variant_null(F.try_parse_json(escaped)).isNotNull(), escaped).otherwise(json_text(inner)))
        .when(x.rlike(r"^'(?s:.*)'$"), json_text(F.replace(inner, F.lit("''"), F.lit("'"))))
        .when(x.rlike("^[\"']"), UNREADABLE)
        .otherwise(json_text(x))
    )


def flow_json(x: Column) -> Column:
    """A flow list or map on one line as JSON; text that is neither stays text."""
    parts = F.transform(F.regexp_extract_all(x, F.lit(FLOW), F.lit(0)), lambda p: F.trim(p))

    def joined(ps):
        mark = lambda p: p.isin("[", "]", "{", "}", ",", ":")
        at = lambda i: F.coalesce(F.get(ps, i), F.lit(""))

        def one(p, i):
            key = (at(i + 1) == ":") & ~p.rlike(r"^\"")
            closes = (p == ",") & at(i + 1).isin("]", "}")
            return F.when(closes, "").when(mark(p), p).when(key, json_text(F.regexp_replace(p, r"^'(.*)'$", "$1"))).otherwise(plain_json(p))

        return F.array_join(F.transform(ps, one), "")

    return let(let(parts, joined), lambda j: F.when(F.try_parse_json(j).isNotNull(), j).otherwise(json_text(x)))


def scalar_json(x: Column) -> Column:
    return let(F.trim(x), lambda t: F.when(t.rlike(r"^[\[{]"), flow_json(t)).otherwise(plain_json(t)))


def _folded(lines: Column, head: Column) -> Column:
    """The lines of a literal or folded text as JSON."""
    indent = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, "^ *", 0)))), F.lit(0))
    cut = F.transform(lines, lambda x: F.substring(x, indent + 1, F.length(x)))

    def ended(t):
        body = F.regexp_replace(t, r"\n+$", "")
        # Folding turns single line ends between lines that aren't indented further into spaces.
        body = F.when(head["style"] == ">", F.regexp_replace(F.regexp_replace(body, r"(?<=[^\n])\n(?=[^\s])(?<!\n\n)", " "), r"\n(\n+)", "$1")).otherwise(body)
        return F.when(body == "", "").when(head["keep"] == "-", body).when(head["keep"] == "+", F.concat(body, F.regexp_extract(t, r"\n*$", 0), F.lit("\n"))).otherwise(F.concat(body, F.lit("\n")))

    return json_text(let(F.array_join(cut, "\n"), ended))


def _tokens(line: Column) -> Column:
    """What a line holds: its item marks, then a key with what follows it, a scalar, or nothing."""
    indent = F.length(F.regexp_extract(line, r"^ *", 0))
    clean = F.rtrim(F.regexp_replace(line, COMMENT, "$1"))
    dashes = F.regexp_extract(clean, r"^ *((?:-(?: +|$))*)", 1)
    rest = F.regexp_replace(clean, r"^ *(?:-(?: +|$))*", "")
    nothing = F.trim(line).rlike(r"^(?:#.*)?$")

    def token(kind, col, key, value, first):
        return F.struct(
            F.lit(first).alias("first") if isinstance(first, bool) else first.alias("first"), line.alias("raw"), indent.alias("indent"), (F.trim(line) == "").alias("blank"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), col.cast("int").alias("col"), key.alias("key"), value.alias("value"),
        )

    empty = F.lit("")
    marks = F.regexp_extract_all(dashes, F.lit(r"- *"), F.lit(0))
    items = F.transform(marks, lambda m, i: token("d", indent + F.length(F.array_join(F.slice(marks, F.lit(1), i), "")), empty, empty, i == 0))
    is_key = rest.rlike(KEY) & ~rest.rlike(r"^[\[{]")
    last = token(F.when(is_key, "k").otherwise("s"), indent + F.length(dashes), F.regexp_extract(rest, KEY, 1), F.when(is_key, F.regexp_extract(rest, KEY, 2)).otherwise(rest), F.size(marks) == 0)
    none = F.array(token("n", indent, empty, empty, True))
    return F.when(nothing, none).when(rest == "", items).otherwise(F.concat(items, F.array(last)))


def _key_json(key: Column) -> Column:
    return F.when(key.rlike(r"^[\"']"), plain_json(key)).otherwise(json_text(key))


def block_json(lines: Column) -> Column:
    """The map that lines of YAML hold, as JSON; null where they hold no map or can't be read.

    A fold over the lines' marks, keys and scalars keeps a stack of the open maps and lists with their columns.
    """
    closers = lambda stack: F.array_join(F.transform(F.reverse(stack), lambda s: F.when(s["kind"] == "m", "}").otherwise("]")), "")

    def state(out, stack, held, open_, text, lines_, bad):
        return F.struct(out.alias("out"), stack.alias("stack"), held.alias("held"), open_.alias("open"), text.alias("text"), lines_.alias("lines"), bad.alias("bad"))

    no_text, no_lines, no, yes, blank = F.lit(None).cast(_TEXT), F.array().cast("array<string>"), F.lit(False), F.lit(True), F.lit("")

    def placed(acc, t, out, open_):
        """acc after a mark or key t, with what stood open written out."""
        n = F.size(acc["stack"])
        top = F.get(acc["stack"], n - 1)
        dash, col = t["kind"] == "d", t["col"]
        nested = (n == 0) | (col > top["col"]) | (dash & (col == top["col"]) & (top["kind"] == "m"))
        wrong = nested & (n > 0) & (~open_ | (acc["held"] != ""))
        out = F.when(~nested & open_, F.concat(out, scalar_json(acc["held"]))).otherwise(out)
        stays = lambda s: F.when(dash, s["col"] <= col).otherwise((s["col"] < col) | ((s["col"] == col) & (s["kind"] == "m")))
        kept = F.filter(acc["stack"], stays)

        def entered(x):
            kept, out = x["kept"], x["out"]
            over = F.get(kept, F.size(kept) - 1)
            kind = F.when(dash, "l").otherwise("m")
            same = ~x["nested"] & (over["col"] == col) & (over["kind"] == kind)
            out = F.concat(out, closers(F.slice(acc["stack"], F.size(kept) + 1, F.size(acc["stack"]))))
            begun = F.when(same, F.concat(out, F.lit(","))).when(dash, F.concat(out, F.lit("["))).otherwise(F.concat(out, F.lit("{")))
            written = F.when(dash, begun).otherwise(F.concat(begun, _key_json(t["key"]), F.lit(":")))
            stack = F.when(same, kept).otherwise(F.concat(kept, F.array(F.struct(col.alias("col"), kind.alias("kind")))))
            head = F.when(~dash & t["value"].rlike(TEXT_HEAD), F.struct(F.regexp_extract(t["value"], TEXT_HEAD, 1).alias("style"), F.concat(F.regexp_extract(t["value"], TEXT_HEAD, 2), F.regexp_extract(t["value"], TEXT_HEAD, 3)).alias("keep"), col.alias("col")))
            return state(written, stack, F.when(head.isNotNull(), "").otherwise(t["value"]), head.isNull(), head, no_lines, acc["bad"] | x["wrong"] | (~x["nested"] & ~F.coalesce(same, no)))

        return let(F.struct(kept.alias("kept"), out.alias("out"), nested.alias("nested"), wrong.alias("wrong")), entered)

    def step(acc, t):
        inside = acc["text"].isNotNull() & (t["blank"] | (t["indent"] > acc["text"]["col"]))
        more = state(acc["out"], acc["stack"], acc["held"], acc["open"], acc["text"], F.when(t["first"], F.concat(acc["lines"], F.array(t["raw"]))).otherwise(acc["lines"]), acc["bad"])

        def outside(out):
            top = F.get(acc["stack"], F.size(acc["stack"]) - 1)
            goes_on = acc["open"] & F.coalesce(t["col"] > top["col"], no)
            joined = F.when(acc["held"] == "", t["value"]).otherwise(F.concat(acc["held"], F.lit(" "), t["value"]))
            scalar = state(out, acc["stack"], F.when(goes_on, joined).otherwise(acc["held"]), acc["open"], no_text, no_lines, acc["bad"] | ~goes_on)
            unchanged = state(out, acc["stack"], acc["held"], acc["open"], no_text, no_lines, acc["bad"])
            return F.when(t["kind"] == "n", unchanged).when(t["kind"] == "s", scalar).otherwise(placed(acc, t, out, acc["open"]))

        flushed = F.when(acc["text"].isNotNull(), F.concat(acc["out"], _folded(acc["lines"], acc["text"]))).otherwise(acc["out"])
        return F.when(inside, more).otherwise(let(flushed, outside))

    def finish(acc):
        tail = F.when(acc["text"].isNotNull(), _folded(acc["lines"], acc["text"])).when(acc["open"], scalar_json(acc["held"])).otherwise("")
        whole = F.concat(acc["out"], tail, closers(acc["stack"]))
        return F.when(~acc["bad"] & whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole)

    start = state(blank, F.array().cast(_STACK), blank, no, no_text, no_lines, no)
    return F.aggregate(F.flatten(F.transform(lines, _tokens)), start, step, finish)
