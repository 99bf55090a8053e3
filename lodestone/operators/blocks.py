"""The block structure of Markdown, line by line: a fold over a note's lines that keeps a stack of open quotes and list items.

Every line gets its kind, its text without the marks of the quotes and items that it stands in, and the number of the paragraph that it
belongs to.  A mask, made once per note, blanks code spans, HTML and comments (over lines too) at equal length, so that what is found in masked
text has the places of the text.  All of it is built-in expressions within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import held
from ..functions.text import let, once

#: Fixed patterns of block syntax.
FENCE = r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
UNDERLINE = r"^ {0,3}(=+|-+)\s*$"
RULE = r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"
QUOTE = r"^ {0,3}> ?"
MARKER = r"^( {0,3})([-*+]|\d{1,9}[.)])(\s+|$)"
BOX = r"^\[([ xX])\]\s+"
#: How lines begin that can't be anything but text, or an item of such text.
PLAIN = r"^[^\s>#<`~*+_=\-\d]"
ITEM = r"^[-*+] " + PLAIN[1:]
COMMENT = r"^ {0,3}<!--"
TAG_LINE = r"^ {0,3}</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>\s*$"
#: Fixed words: elements whose tag begins a block of HTML even within a paragraph.
ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param pre script search section style summary table tbody td textarea tfoot th thead title tr track ul"
)
BLOCK_TAG = rf"(?i)^ {{0,3}}</?(?:{ELEMENTS.replace(' ', '|')})(?:\s|/?>|$)"

#: A code span, and what a mask blanks; \x01 stands between paragraphs.
CODE = r"(?<!`)(`+)(?!`)[^\x01]*?(?<!`)\1(?!`)"
_PIECES = rf"{CODE}|<!--(?:(?!-->)[^\x01])*-->|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>\x01]*)?/?>|<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\x01]*>|\\[!-/:-@\[-`{{-~]|`+|[^`<\\]+|[<\\]"

#: y frontmatter, b blank, p paragraph, h heading with marks, u underline of a heading, r rule, x HTML, d indented code, o opening mark of a fence, f code in it, e its closing mark.
PROSE = ("p", "h")
_LINE = "struct<line:int,kind:string,text:string,at:int,col:int,item:boolean,group:int,part:int>"
_STATE = "struct<stack:array<struct<quote:boolean,need:int>>,leaf:string,mark:string,group:int,part:int>"
#: Whether items, headings, blank lines and code at the beginning of lines are known at one look; the walk through their containers gives the same.
QUICK = True
#: Lines that one inner fold appends to one array.
CHUNK = 128


def front_lines(lines: Column) -> Column:
    """The number of frontmatter lines, marks included."""
    close = F.array_position(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rtrim(x).isin("---", "...")), True)
    return F.when((F.get(lines, F.lit(0)) == "---") & (close > 0), close + 1).otherwise(F.lit(0)).cast("int")


def _blank(x: Column) -> Column:
    return F.trim(x) == ""


def _indent(x: Column) -> Column:
    return F.length(x) - F.length(F.ltrim(x))


def _state(stack, leaf, mark, group, part) -> Column:
    return F.struct(stack.alias("stack"), (F.lit(leaf) if isinstance(leaf, str) else leaf).alias("leaf"), (F.lit(mark) if isinstance(mark, str) else mark).alias("mark"), group.cast("int").alias("group"), part.cast("int").alias("part"))


def _entered(rest: Column, at: Column, fresh: Column) -> Column:
    """What a line opens before its text: struct<rest, at, opened, col, item>.  `fresh` is false where the line goes on with a paragraph, which not every mark may interrupt."""

    def mark(a, _):
        rest = a["rest"]
        quote = rest.rlike(QUOTE)
        lead, bullet, gap = (F.regexp_extract(rest, MARKER, n) for n in (1, 2, 3))
        free = a["item"] | (F.size(a["opened"]) > 0) | fresh
        item = rest.rlike(MARKER) & ~rest.rlike(RULE) & (free | (~_blank(F.regexp_replace(rest, MARKER, "")) & bullet.isin("-", "*", "+", "1.", "1)")))
        # Text starts after one to four blanks; more are the start of indented code.
        wide = (F.length(gap) > 4) | _blank(F.regexp_replace(rest, MARKER, ""))
        need = F.length(lead) + F.length(bullet) + F.when(wide, 1).otherwise(F.length(gap))
        width = F.when(quote, F.length(F.regexp_extract(rest, QUOTE, 0))).otherwise(need)
        opened = F.concat(a["opened"], F.array(F.struct(quote.alias("quote"), F.when(quote, 0).otherwise(need).alias("need"))))
        after = F.struct(
            F.substring(rest, width + 1, F.length(rest)).alias("rest"), (a["at"] + width).alias("at"), opened.alias("opened"),
            F.when(quote, a["col"]).otherwise(a["at"] + F.length(lead)).alias("col"), (~quote).alias("item"),
        )
        return F.when(quote | item, after).otherwise(a)

    start = F.struct(rest.alias("rest"), at.alias("at"), F.array().cast("array<struct<quote:boolean,need:int>>").alias("opened"), F.lit(-1).alias("col"), F.lit(False).alias("item"))
    # A line opens at most as many containers as it has marks before its text.
    marks = F.length(F.regexp_replace(F.regexp_extract(rest, r"^(?:\s|>|[-*+](?=\s|$)|\d{1,9}[.)](?=\s|$))*", 0), r"\d+|\s", ""))
    return F.when(marks == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(marks - 1, F.lit(0))), start, mark))


def _step(state: Column, x: Column, line: Column, front: Column) -> Column:
    """struct<state, out> of a line after those before it."""

    def result(kind, text, at, col, item, group, part):
        return F.struct(
            line.cast("int").alias("line"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), at.cast("int").alias("at"), col.cast("int").alias("col"),
            item.alias("item"), group.cast("int").alias("group"), part.cast("int").alias("part"),
        )

    def both(after, out):
        return F.struct(after.alias("state"), out.alias("out"))

    no, zero, stack, leaf = F.lit(False), F.lit(0), state["stack"], state["leaf"]
    raw = F.when(F.contains(x, F.lit("\t")), F.regexp_replace(x, r"\G( *)\t", "$1    ")).otherwise(x)

    def matched(a, c):
        rest = a["rest"]
        width = F.when(c["quote"], F.length(F.regexp_extract(rest, QUOTE, 0))).otherwise(F.when(_blank(rest), F.least(c["need"], F.length(rest))).otherwise(c["need"]))
        fits = a["ok"] & F.when(c["quote"], rest.rlike(QUOTE)).otherwise(_blank(rest) | (_indent(rest) >= c["need"]))
        return F.when(fits, F.struct(F.substring(rest, width + 1, F.length(rest)).alias("rest"), (a["at"] + width).alias("at"), (a["n"] + 1).alias("n"), F.lit(True).alias("ok"))).otherwise(
            F.struct(rest.alias("rest"), a["at"].alias("at"), a["n"].alias("n"), F.lit(False).alias("ok"))
        )

    begin = F.struct(raw.alias("rest"), zero.alias("at"), zero.alias("n"), F.lit(True).alias("ok"))
    walked = F.when(F.size(stack) == 0, begin).otherwise(F.aggregate(stack, begin, matched))

    def within(w):
        whole = w["n"] == F.size(stack)
        new = state["group"] + 1
        char = F.substring(state["mark"], 1, 1)
        closes = F.rtrim(w["rest"]).rlike(r"^ {0,3}(?:`{3,}|~{3,})$") & (F.substring(F.ltrim(w["rest"]), 1, 1) == char) & (F.length(F.trim(w["rest"])) >= F.length(state["mark"]))
        fence = both(
            _state(stack, F.when(closes, "").otherwise("f"), state["mark"], new, state["part"]), result(F.when(closes, "e").otherwise("f"), w["rest"], w["at"], F.lit(-1), no, new, state["part"])
        )
        ends = F.when(leaf == "c", F.contains(w["rest"], F.lit("-->"))).otherwise(_blank(w["rest"]))
        html = both(_state(stack, F.when(ends, "").otherwise(leaf), "", new, state["part"]), result("x", w["rest"], w["at"], F.lit(-1), no, new, state["part"]))
        return F.when(whole & (leaf == "f"), fence).when(whole & leaf.isin("c", "t"), html).otherwise(let(_entered(w["rest"], w["at"], ~(whole & (leaf == "p"))), lambda e: opened(w, whole, e)))

    def opened(w, whole, e):
        rest, anew = e["rest"], F.size(e["opened"]) > 0
        goes_on, blank = whole & ~anew, _blank(rest)
        # Only a leaf whose containers all go on goes on itself; a paragraph does so in lines that merely lack their marks.
        held = F.when(goes_on, leaf).otherwise("")
        deep = (_indent(rest) >= 4) & ~blank & (held != "p")
        comment = rest.rlike(COMMENT)
        kind = (
            F.when(blank, "b").when(rest.rlike(PLAIN), "p").when(deep, "d").when((held == "p") & rest.rlike(UNDERLINE), "u").when(rest.rlike(FENCE), "o").when(rest.rlike(HEADING), "h").when(rest.rlike(RULE), "r")
            .when(comment | rest.rlike(BLOCK_TAG) | ((held != "p") & rest.rlike(TAG_LINE)), "x").otherwise("p")
        )

        def placed(k):
            lazy = (k == "p") & ~whole & ~anew & (leaf == "p")
            kept = F.when(lazy | whole, stack).otherwise(F.slice(stack, F.lit(1), w["n"]))
            kept = F.when(anew, F.concat(kept, e["opened"])).otherwise(kept)
            same = ((k == "p") & ((held == "p") | lazy)) | (k == "u") | (k.isin("d", "b") & (held == "d"))
            group = F.when(same & (k != "d") & (k != "b"), state["group"]).otherwise(state["group"] + 1)
            part = F.when(same, state["part"]).otherwise(line)
            open_comment = comment & ~F.contains(F.regexp_replace(rest, r"^ {0,3}<!--", ""), F.lit("-->"))
            after = (
                F.when(k == "b", F.when(held == "d", "d").otherwise("")).when(k == "o", "f").when(k == "x", F.when(comment, F.when(open_comment, "c").otherwise("")).otherwise("t"))
                .when(k.isin("p", "d"), k).otherwise("")
            )
            mark = F.when(k == "o", F.regexp_extract(rest, FENCE, 1)).otherwise("")
            return both(_state(kept, after, mark, group, part), result(k, rest, e["at"], e["col"], e["item"], group, part))

        return let(kind, placed)

    # Most lines are text or blank outside all containers, which one look tells.
    plain = (F.size(stack) == 0) & leaf.isin("", "p")
    blank_line = both(_state(stack, "", "", state["group"] + 1, line), result("b", raw, zero, F.lit(-1), no, state["group"] + 1, line))
    goes_on = leaf == "p"
    group, part = F.when(goes_on, state["group"]).otherwise(state["group"] + 1), F.when(goes_on, state["part"]).otherwise(line)
    text_line = both(_state(stack, "p", "", group, part), result("p", raw, zero, F.lit(-1), no, group, part))
    front_line = both(_state(stack, leaf, state["mark"], state["group"] + 1, line), result("y", x, zero, F.lit(-1), no, state["group"] + 1, line))
    # So are these, whatever containers are open, as long as no fence or HTML outside containers takes them in: items and headings right at the line's beginning leave all
    # containers, and a blank line goes on with items.  Lines of a fence outside containers that can't close it are code.
    known = F.lit(QUICK)
    free = known & ((F.size(stack) > 0) | ~leaf.isin("f", "c", "t"))
    one = F.array(F.struct(no.alias("quote"), F.lit(2).alias("need")))
    item_line = both(_state(one, "p", "", state["group"] + 1, line), result("p", F.substring(raw, 3, 1 << 30), F.lit(2), zero, F.lit(True), state["group"] + 1, line))
    heading_line = both(_state(F.slice(stack, F.lit(1), F.lit(0)), "", "", state["group"] + 1, line), result("h", raw, zero, F.lit(-1), no, state["group"] + 1, line))
    code_line = both(_state(stack, "f", state["mark"], state["group"] + 1, state["part"]), result("f", raw, zero, F.lit(-1), no, state["group"] + 1, state["part"]))
    gap_line = known & (raw == "") & leaf.isin("", "p") & ~F.exists(stack, lambda c: c["quote"])
    return (
        F.when(line <= front, front_line).when(plain & (raw == ""), blank_line).when(plain & raw.rlike(PLAIN), text_line)
        .when(free & raw.rlike(ITEM), item_line).when(free & raw.startswith("#") & raw.rlike(HEADING), heading_line).when(gap_line, blank_line)
        .when(known & (F.size(stack) == 0) & (leaf == "f") & ~raw.rlike(r"^\s*[`~]"), code_line).otherwise(let(walked, within))
    )


def block_lines(lines: Column, front: Column) -> Column:
    """array<struct<line, kind, text, at, col, item, group, part>> of a note's lines.

    at is how much of the line stands before the text, col where the mark of the innermost item that the line opens stands, item whether it opens one right
    before its text, group the number of the paragraph, part the first line of the paragraph or code.
    """
    size = F.size(lines)

    def one(acc, i):
        done = let(_step(acc["state"], F.get(lines, i), i + 1, front), lambda s: s)
        return let(done, lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

    def chunk(acc, c):
        start = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{_LINE}>").alias("out"))
        inner = F.aggregate(F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, size) - 1), start, one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    first = _state(F.array().cast("array<struct<quote:boolean,need:int>>"), "", "", F.lit(-1), F.lit(0)).cast(_STATE)
    start = F.struct(first.alias("state"), F.array().cast(f"array<array<{_LINE}>>").alias("outs"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), start, chunk, lambda acc: acc["outs"]))


def _paragraphs(rows: Column) -> Column:
    """Each group's text, its lines joined; other lines than prose are empty."""

    def piece(r, i):
        text = F.when(r["kind"].isin(*PROSE), F.translate(r["text"], "\x01", " ")).otherwise("")
        return F.concat(F.when(i == 0, "").when(F.get(rows, i - 1)["group"] == r["group"], "\n").otherwise("\x01"), text)

    return F.array_join(F.transform(rows, piece), "")


def masked(text: Column) -> Column:
    """Text with code spans and HTML as NULs, and the backslashes of escapes as \\x02, line ends kept."""

    def blanked(p):
        opaque = ((F.substring(p, 1, 1) == "<") & (F.length(p) > 1)) | (p.startswith("`") & ~p.rlike("^`+$"))
        return F.when(opaque, F.regexp_replace(p, r"[^\n\x01]", "\x00")).when(p.startswith("\\") & (F.length(p) == 2), F.concat(F.lit("\x02"), F.substring(p, 2, 1))).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), blanked), "")


@once
def _parts() -> tuple[Column, ...]:
    return (
        F.when(F.col("contents_").startswith("---"), front_lines(F.col("lines"))).otherwise(0), block_lines(F.col("lines"), F.col("front")), _paragraphs(F.col("rows")),
        F.when(F.col("shown").rlike(r"[`<\\]"), masked(F.col("shown"))).otherwise(F.col("shown")),
    )


def parsed(notes: DataFrame, *keep: str) -> DataFrame:
    """(path, kept columns, lines, front, rows, shown, mask): a note's lines, how many are frontmatter, what block_lines says of them, and the texts and masked texts of its groups."""
    contents = F.coalesce(F.col("contents"), F.lit(""))
    d = held(notes.select("path", *keep, contents.alias("contents_")), lines=F.split("contents_", r"\r?\n"))
    for name, part in zip(("front", "rows", "shown", "mask"), _parts()):
        d = held(d, **{name: part})
    d = held(d.withColumnsRenamed({"shown": "shown_", "mask": "mask_"}), shown=F.split("shown_", "\x01", -1), mask=F.split("mask_", "\x01", -1))
    return d.select("path", *keep, "lines", "front", "rows", "shown", "mask")
