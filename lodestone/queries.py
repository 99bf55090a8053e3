"""Registered queries over the driver's tables: each with SQL that computes the same rows straight from the columns.

Markdown operators run on notes that are written from columns, so their SQL twin needs no Markdown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .functions.frames import spread
from .operators import checks, notequery, pages, render, search
from .operators import markdown as M
from .operators import tasks as T
from .plans import views
from .sources import vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark, sf_dir, name, *order) -> notequery.NoteQuery:
    return notequery.NoteQuery(table(spark, sf_dir, name), order)


# Queries over records.


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NULL OR o_totalprice >= 400000 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20")
def table_filter_sort_limit(spark, sf_dir):
    q = query(spark, sf_dir, "orders", "o_orderkey").compare("o_totalprice", ">=", 400000).sort("-o_totalprice", "o_orderkey").limit(20)
    return q.show("o_orderkey", "o_totalprice").run().rows


@registered("SELECT p_partkey AS part, p_name AS name, p_size AS size FROM part WHERE p_size < 10 ORDER BY p_name, p_partkey LIMIT 50")
def table_without_id_alias(spark, sf_dir):
    q = query(spark, sf_dir, "part", "p_partkey").compare("p_size", "<", 10).sort("p_name").limit(50)
    return q.show(part=q.term("p_partkey"), name=q.term("p_name"), size=q.term("p_size")).run().rows


@registered("SELECT 'customers/' || c_custkey || '.md' AS \"File\", c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def list_projection(spark, sf_dir):
    d = table(spark, sf_dir, "customer").withColumn("file.link", F.concat(F.lit("customers/"), "c_custkey", F.lit(".md")))
    q = notequery.NoteQuery(d, ("c_custkey",)).compare("c_mktsegment", "=", "BUILDING")
    return q.show("c_name").run(file_link="file.link").rows


@registered("SELECT 'nations/' || n_name || '.md' AS \"File\" FROM nation")
def list_default_link(spark, sf_dir):
    notes = table(spark, sf_dir, "nation").select(F.concat(F.lit("nations/"), "n_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "n_name").alias("contents"))
    return notequery.NoteQuery(pages.page_records(notes), ("`file.path`",)).run(file_link="file.link", fields=False).rows


@registered("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND (l_returnflag = 'R' OR l_linestatus = 'O') AND NOT (l_discount > 0.05)")
def where_repeated_and_or_not(spark, sf_dir):
    q = query(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    flags = V.eq(q.term("l_returnflag"), V.literal("R")) | V.eq(q.term("l_linestatus"), V.literal("O"))
    return q.compare("l_quantity", ">", 30).where(flags).where(~V.gt(q.term("l_discount"), V.literal(0.05))).show("l_orderkey", "l_linenumber").run().rows


_NULLED = "(SELECT o_orderkey, nullif(o_custkey % 5, 0) AS a, nullif(o_orderkey % 4, 0) AS b FROM orders)"


@registered(f"""SELECT o_orderkey, a IS NOT DISTINCT FROM b AS eq, a IS DISTINCT FROM b AS ne, coalesce(a IS NOT NULL AND (b IS NULL OR a < b), false) AS lt,
 coalesce(b IS NULL OR (a IS NOT NULL AND a <= b), false) AS le, coalesce(b IS NOT NULL AND (a IS NULL OR a > b), false) AS gt, coalesce(a IS NULL OR (b IS NOT NULL AND a >= b), false) AS ge FROM {_NULLED}""")
def cmp_null_greatest(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "nullif(o_custkey % 5, 0) AS a", "nullif(o_orderkey % 4, 0) AS b")
    a, b = V.field(d, "a"), V.field(d, "b")
    named = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return d.select("o_orderkey", *[F.coalesce(V.COMPARE[op](a, b), F.lit(False)).alias(n) for n, op in named.items()])


@registered("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NULL OR v >= 90")
def null_greatest_ge(spark, sf_dir):
    d = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v")
    return d.where(V.ge(V.field(d, "v"), V.literal(90))).select("event_id")


@registered("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events) ORDER BY v DESC NULLS FIRST, event_id LIMIT 150")
def desc_nulls_first(spark, sf_dir):
    d = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v")
    return notequery.NoteQuery(d, ("event_id",)).sort("-v").limit(150).show("event_id", "v").run().rows


@registered("SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) >= '7'")
def cmp_number_vs_string(spark, sf_dir):
    return query(spark, sf_dir, "part", "p_partkey").compare("p_size", ">=", "7").show("p_partkey").run().rows


@registered("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS s, o_custkey % 3 AS n FROM orders) WHERE s <> '' AND n <> 0")
def truthy_filter(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS s", "o_custkey % 3 AS n")
    q = notequery.NoteQuery(d, ("o_orderkey",))
    return q.where(q.term("s"), q.term("n")).show("o_orderkey").run().rows


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) IS NULL OR CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def nested_lookup_json(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k double").alias("props"))
    q = notequery.NoteQuery(d, ("event_id",)).compare("props.k", ">=", 50)
    return q.show("event_id", k=q.term("props.k")).run().rows


@registered("SELECT doc_id FROM documents WHERE contains(text, 'that')")
def contains_string(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where(V.contains(V.field(d, "text"), V.literal("that"))).select("doc_id")


@registered("SELECT doc_id FROM documents WHERE lang = 'en' OR source = 'src1'")
def contains_array(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    t = V.field(d, "tags")
    return d.where(V.contains(t, V.literal("en")) | V.contains(t, V.literal("src1"))).select("doc_id")


@registered("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') <= '1994-06-15'")
def date_today_literal(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    today = V.Term(V.date_text(V.field(d, "today"), "1994-06-15"), d.schema["day"].dataType)
    return d.where(V.le(V.field(d, "day"), today)).select("o_orderkey")


@registered("SELECT n_name, CAST(NULL AS VARCHAR) AS nothing FROM nation")
def unknown_field_null(spark, sf_dir):
    d = table(spark, sf_dir, "nation")
    return d.select("n_name", V.text(V.field(d, "no.such.field")).alias("nothing"))


@registered("""SELECT event_id, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS t FROM (SELECT event_id, (event_id % 1000) / 4.0 AS x FROM events)""")
def number_text(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 1000) / 4.0).alias("x"))
    return d.select("event_id", V.text(V.field(d, "x")).alias("t"))


_DOC_NOTES = "(SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, ['#' || lang, '#doc/' || source] AS tags FROM documents)"


def _doc_notes(spark, sf_dir):
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".md")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.array(F.concat(F.lit("#"), "lang"), F.concat(F.lit("#doc/"), "source")).alias("tags"))


@registered(f"SELECT path FROM {_DOC_NOTES} WHERE starts_with(path, 'src1/')")
def from_path(spark, sf_dir):
    return _doc_notes(spark, sf_dir).where(vault.in_scope(F.col("path"), "src1")).select("path")


@registered(f"SELECT path FROM {_DOC_NOTES} WHERE list_contains(tags, '#de')")
def from_tag(spark, sf_dir):
    d = _doc_notes(spark, sf_dir)
    return d.where(notequery.from_tag(d, "#de")).select("path")


@registered(f"SELECT path FROM {_DOC_NOTES} WHERE (starts_with(path, 'src2/') AND list_contains(tags, '#en')) OR path = 'src1/en/1.md' OR list_contains(tags, '#doc/src3')")
def from_and_or(spark, sf_dir):
    d = _doc_notes(spark, sf_dir)
    path = F.col("path")
    composed = (notequery.from_path(path, "src2") & notequery.from_tag(d, "#en")) | notequery.from_path(path, "src1/en/1") | notequery.from_tag(d, "#doc/src3")
    return d.where(composed).select("path")


@registered("SELECT doc_id, unnest(['#doc', '#doc/' || source, '#doc/' || source || '/' || lang, '#' || lang]) AS tag FROM documents")
def tag_expansion(spark, sf_dir):
    tags = F.array(F.concat(F.lit("#doc/"), "source", F.lit("/"), "lang"), F.concat(F.lit("#"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.expanded_tags(tags)).alias("tag"))


@registered("""SELECT key, key AS label, array_to_string(list(i ORDER BY i), ',') AS row_indexes FROM (SELECT o_orderpriority AS key, row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS i FROM orders QUALIFY i < 200) GROUP BY key""")
def group_row_indexes(spark, sf_dir):
    q = query(spark, sf_dir, "orders", "o_orderkey").sort("-o_totalprice").limit(200).group_by("o_orderpriority")
    return q.groups().withColumn("row_indexes", F.array_join("row_indexes", ","))


_PLACES = "(SELECT o_orderpriority AS key, row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS i FROM orders)"


@registered(f"SELECT key, count(*) AS n, min(i) AS first, max(i) AS last, CAST(sum(i) AS BIGINT) AS total FROM {_PLACES} GROUP BY key")
def group_rows_without_limit(spark, sf_dir):
    q = query(spark, sf_dir, "orders", "o_orderkey").sort("-o_totalprice").group_by("o_orderpriority")
    return q.group_rows().groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"), F.sum("i").alias("total"))


@registered(f"SELECT key, CAST(sum(i) AS BIGINT) AS total, count(*) AS n FROM {_PLACES} GROUP BY key")
def group_arrays_without_limit(spark, sf_dir):
    q = query(spark, sf_dir, "orders", "o_orderkey").sort("-o_totalprice").group_by("o_orderpriority")
    return q.groups().select("key", F.aggregate("row_indexes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("row_indexes").cast("long").alias("n"))


@registered("SELECT p_partkey, contains(p_name, 'a') AS held, '1994-06-15' AS day, CAST(NULL AS VARCHAR) AS nothing FROM part")
def functions_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    call = lambda name, *args: V.call(name, *args, today="1994-06-15").column
    return d.select("p_partkey", call("contains", V.field(d, "p_name"), V.literal("a")).alias("held"), call("date", V.literal("today")).alias("day"), call("lower", V.field(d, "p_name")).cast("string").alias("nothing"))


@registered("""SELECT key, row_number() OVER (ORDER BY r, p) - 1 AS ord FROM (SELECT key, min(event_id * 10) AS r, min(p) AS p FROM (SELECT event_id, event_type AS key, 0 AS p FROM events UNION ALL SELECT event_id, 'k' || (event_id % 5), 1 FROM events) GROUP BY key)""")
def columns_first_seen(spark, sf_dir):
    pair = lambda k: F.struct(k.alias("key"), F.lit("v").alias("value"))
    d = table(spark, sf_dir, "events").select("event_id", F.array(pair(F.col("event_type")), pair(F.concat(F.lit("k"), F.col("event_id") % 5))).alias("fields"))
    return notequery.first_seen_keys(d, "event_id", "fields")


# Extraction from notes that are written from columns.

_FENCE = "```"


def _part_notes(spark, sf_dir):
    """Two headings, frontmatter, a link with alias, a tag, fields, a list, and code that must give no records."""
    return spread(table(spark, sf_dir, "part")).select(
        F.format_string("parts/%d.md", "p_partkey").alias("path"),
        F.concat_ws(
            "\n", F.lit("---"), F.concat(F.lit("type: part\nsize: "), "p_size"), F.lit("tags: [part, shop/tool]"), F.lit("---"), F.concat(F.lit("# "), "p_name"), F.lit(""),
            F.format_string("See [[supplier-%d#Terms|the supplier]] and [[%s]] for `[[code]] #code` #brand/%s [price:: %d] ^p%d", F.col("p_partkey") % 10, "p_brand", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-")), F.col("p_size") * 2, "p_partkey"),
            F.lit("## Notes"), F.concat(F.lit("kind:: "), "p_type"), F.lit("- first point"), F.lit("- [x] done point"), F.lit("    - [ ] open point (who:: [[Ann]])"),
            F.lit(_FENCE + "sql numbered"), F.lit("# not a heading [[no link]] #notag"), F.concat(F.lit("select "), "p_size"), F.lit(_FENCE), F.lit("### Deep"), F.lit("## Second"),
        ).alias("contents"),
    )


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, unnest(['type', 'size', 'tags']) AS key, unnest(['part', CAST(p_size AS VARCHAR), '[part, shop/tool]']) AS value FROM part")
def frontmatter_roundtrip(spark, sf_dir):
    return M.frontmatter(_part_notes(spark, sf_dir)).select("path", "key", "value")


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, unnest(['price', 'who']) AS key, unnest([CAST(p_size * 2 AS VARCHAR), '[[Ann]]']) AS value FROM part")
def inline_field_roundtrip(spark, sf_dir):
    return M.inline_fields(_part_notes(spark, sf_dir)).select("path", "key", "value")


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, 10 AS line, 'kind' AS key, p_type AS value FROM part")
def bare_field_roundtrip(spark, sf_dir):
    return M.bare_fields(_part_notes(spark, sf_dir)).select("path", "line", "key", "value")


_HEADINGS = "(SELECT 'parts/' || p_partkey || '.md' AS path, unnest([6, 9, 18, 19]) AS line, unnest([1, 2, 3, 2]) AS depth, unnest([p_name, 'Notes', 'Deep', 'Second']) AS text, unnest([NULL, 6, 9, 6]) AS parent FROM part)"


@registered(f"SELECT path, line, depth, text FROM {_HEADINGS}")
def headings_extract(spark, sf_dir):
    return M.headings(_part_notes(spark, sf_dir)).drop("source")


@registered(f"SELECT path, line, depth, text, parent FROM {_HEADINGS}")
def toc_parent(spark, sf_dir):
    return M.table_of_contents(_part_notes(spark, sf_dir))


@registered("""SELECT 'parts/' || p_partkey || '.md' AS path, unnest(['supplier-' || (p_partkey % 10), split_part(p_brand, '#', 1), 'Ann']) AS target, unnest(['Terms', split_part(p_brand, '#', 2), NULL]) AS header, unnest(['the supplier', NULL, NULL]) AS alias,
 unnest(['the supplier', split_part(p_brand, '#', 1), 'Ann']) AS value, unnest([8, 8, 13]) AS line FROM part""")
def links_extract(spark, sf_dir):
    return M.links(_part_notes(spark, sf_dir)).select("path", "target", "header", "alias", "value", "line")


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, 8 AS line, '#brand/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS value FROM part")
def tags_extract(spark, sf_dir):
    return M.tags(_part_notes(spark, sf_dir)).select("path", "line", "value")


@registered("""SELECT 'parts/' || p_partkey || '.md' AS path, array_to_string(['#part', '#shop/tool', b], ' ') AS etags, array_to_string(['#part', '#shop', '#shop/tool', '#brand', b], ' ') AS tags
 FROM (SELECT p_partkey, '#brand/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS b FROM part)""")
def note_tags(spark, sf_dir):
    return M.note_tags(_part_notes(spark, sf_dir)).select("path", F.array_join("etags", " ").alias("etags"), F.array_join("tags", " ").alias("tags"))


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, unnest([11, 12, 13]) AS line, unnest([NULL, true, false]) AS checked, unnest(['first point', 'done point', 'open point Ann']) AS text FROM part")
def list_items_extract(spark, sf_dir):
    return M.list_items(_part_notes(spark, sf_dir)).select("path", "line", "checked", "text")


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, 14 AS line, 'sql' AS language, 'numbered' AS meta, '# not a heading [[no link]] #notag' || chr(10) || 'select ' || p_size AS value FROM part")
def fenced_blocks_extract(spark, sf_dir):
    return M.fenced_blocks(_part_notes(spark, sf_dir))


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, 'p' || p_partkey AS id FROM part")
def block_anchors_extract(spark, sf_dir):
    return M.block_anchors(_part_notes(spark, sf_dir)).select("path", "id")


@registered("SELECT 'parts/' || p_partkey || '.md' AS path, unnest(['supplier-' || (p_partkey % 10), split_part(p_brand, '#', 1), 'Bea']) AS target FROM part")
def rename_links(spark, sf_dir):
    return M.links(M.renamed_links(_part_notes(spark, sf_dir), "Ann", "Bea")).select("path", "target")


def _coded_notes(spark, sf_dir):
    """Code spans with syntax inside, indented and fenced code, an underlined heading, and a list whose nested items are as deep as code."""
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s/_"), k, F.lit(".md")).alias("path"),
        F.concat_ws(
            "\n", F.concat(F.lit("# Use `"), "s_name", F.lit("` **well**")), F.lit(""), F.lit("    - [ ] not #task [[x]] [a:: 1]"), F.lit(""), F.lit("\tmore #code"),
            F.concat(F.lit("- [ ] run `[[not]] #no` "), k, F.lit(" #task [cmd:: `ls` "), k, F.lit("] [[Old|see]]")), F.lit("    - [ ] _nested_ #task [due:: 2026-01-02] [due:: bad]"), F.lit(""),
            F.concat(F.lit("Section "), k), F.lit("---"), F.lit("text"), F.lit("    goes on [[Old#part]]"), F.lit("~~~"), F.lit("[[Old]]"), F.lit("~~~"),
        ).alias("contents"),
    )


@registered("SELECT 's/_' || s_suppkey || '.md' AS path, unnest([1, 9]) AS line, unnest([1, 2]) AS depth, unnest(['Use ' || s_name || ' well', 'Section ' || s_suppkey]) AS text FROM supplier")
def headings_with_code(spark, sf_dir):
    return M.headings(_coded_notes(spark, sf_dir)).drop("source")


@registered("SELECT 's/_' || s_suppkey || '.md' AS path, unnest([6, 7]) AS line, unnest(['run [[not]] #no ' || s_suppkey || ' see', 'nested']) AS text, unnest(['`ls` ' || s_suppkey, NULL]) AS cmd, unnest([NULL, 'bad']) AS due_field, CAST(NULL AS VARCHAR) AS due FROM supplier")
def tasks_with_code(spark, sf_dir):
    d = T.tasks(_coded_notes(spark, sf_dir))
    return d.select("path", "line", "text", F.try_element_at("fields", F.lit("cmd")).alias("cmd"), F.try_element_at("fields", F.lit("due")).alias("due_field"), "due")


@registered("SELECT 's/_' || s_suppkey || '.md' AS path, unnest([3, 13]) AS line, unnest(['- [ ] not #task [[x]] [a:: 1]' || chr(10) || chr(10) || 'more #code', '[[Old]]']) AS value FROM supplier")
def code_blocks_extract(spark, sf_dir):
    return M.code_blocks(_coded_notes(spark, sf_dir)).select("path", "line", "value")


@registered("SELECT 's/_' || s_suppkey || '.md' AS path, unnest([6, 12]) AS line, unnest(['[[New|see]]', '[[New#part]]']) AS original FROM supplier")
def rename_links_outside_code(spark, sf_dir):
    d = M.renamed_links(M.renamed_links(_coded_notes(spark, sf_dir), "Old", "New"), "not", "bad").where(F.contains("contents", F.lit("~~~\n[[Old]]\n~~~")) & F.contains("contents", F.lit("`[[not]] #no`")))
    return M.links(d).select("path", "line", "original")


@registered("""SELECT 'parts/' || p_partkey || '.md' AS path, unnest(['type', 'size', 'tags', 'price', 'who', 'kind']) AS key, unnest(['part', CAST(p_size AS VARCHAR), 'part,shop/tool', CAST(p_size * 2 AS VARCHAR), '[[Ann]]', p_type]) AS value FROM part""")
def page_fields(spark, sf_dir):
    return pages.page_records(_part_notes(spark, sf_dir)).select(F.col("`file.path`").alias("path"), F.explode("fields").alias("key", "v")).select("path", "key", F.array_join("v", ",").alias("value"))


@registered("""SELECT CAST(p_partkey AS VARCHAR) AS name, 'parts' AS folder, 'part,shop/tool,' || b AS etags, 'part,shop,shop/tool,brand,' || b AS tags, 'supplier-' || (p_partkey % 10) || ',' || split_part(p_brand, '#', 1) || ',Ann' AS outlinks, 'type | part;size | ' || p_size AS front
FROM (SELECT *, 'brand/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS b FROM part)""")
def page_file_fields(spark, sf_dir):
    c = lambda name: F.col(f"`file.{name}`")
    plain = lambda name: F.replace(F.array_join(c(name), ","), F.lit("#"), F.lit("")).alias(name)
    return pages.page_records(_part_notes(spark, sf_dir)).select(c("name").alias("name"), c("folder").alias("folder"), plain("etags"), plain("tags"), F.array_join(c("outlinks"), ",").alias("outlinks"), F.array_join(c("frontmatter"), ";").alias("front"))


@registered("SELECT 'parts/' || p_partkey || '.md' AS \"File\", CAST(p_size AS VARCHAR) AS size, p_type AS kind FROM part WHERE CAST(p_size AS VARCHAR) >= '4' AND p_type <> 'ECONOMY'")
def page_table_where(spark, sf_dir):
    q = notequery.NoteQuery(pages.page_records(_part_notes(spark, sf_dir)), ("`file.path`",)).source("#shop", "parts", every=True)
    return q.compare("size", ">=", "4").compare("kind", "!=", "ECONOMY").show(size=V.head(q.term("size")), kind=V.head(q.term("kind"))).run(file_link="file.link").rows


@registered("SELECT doc_id, string_split(text, chr(10))[2] AS line FROM documents")
def source_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.source_line(F.col("text"), F.lit(2)).alias("line"))


@registered(f"SELECT path FROM {_DOC_NOTES} WHERE NOT (starts_with(path, 'src1/') AND NOT contains(path, '/en/')) AND NOT ends_with(path, '/7.md')")
def kbignore_last_match(spark, sf_dir):
    rules = "# notes to leave out\nsrc1/\n!src1/en/\n7.md\n"
    return _doc_notes(spark, sf_dir).where(~vault.ignored(F.col("path"), rules)).select("path")


# Tasks.

_TASKS = """(SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS done, strftime(o_orderdate, '%Y-%m-%d') AS day,
 CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS scheduled,
 CASE o_orderkey % 4 WHEN 0 THEN 'every week' WHEN 1 THEN 'every 3 days' WHEN 2 THEN 'weekly' END AS repeat FROM orders)"""


def _task_notes(spark, sf_dir):
    k, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    part = lambda cond, *bits: F.when(cond, F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])).otherwise("")
    return spread(table(spark, sf_dir, "orders")).select(
        F.concat(F.lit("orders/"), k, F.lit(".md")).alias("path"),
        F.concat(
            F.lit("# Plan\n\n- [ ] no task\n- ["), F.when(k % 3 == 0, "x").otherwise(" "), F.lit("] Ship  order "), k, F.lit(" #task #ship"), part(k % 5 < 3, " [due:: ", date.cast("string"), "]"),
            part((k % 5).isin(1, 2, 3), " [scheduled:: ", F.date_add(date, 3).cast("string"), "]"),
            part(k % 4 == 0, " [repeat:: every week]"), part(k % 4 == 1, " [repeat:: every 3 days]"), part(k % 4 == 2, " [repeat:: weekly]"),
            F.lit(" (effort:: "), k % 7, F.lit(") [area:: [[Sales]]] ^o"), k, F.lit("\n"),
        ).alias("contents"),
    )


def _tasks(spark, sf_dir):
    return T.tasks(_task_notes(spark, sf_dir))


@registered(f"SELECT 'orders/' || k || '.md' AS path, 4 AS line, done, 'Ship order ' || k AS text, due, scheduled, repeat, '[[Sales]]' AS area, '#task #ship' AS tags FROM {_TASKS}")
def tasks_extract(spark, sf_dir):
    return _tasks(spark, sf_dir).select("path", "line", "done", "text", "due", "scheduled", "repeat", "area", F.array_join("tags", " ").alias("tags"))


@registered(f"SELECT 'orders/' || k || '.md' AS path, 'effort' AS key, CAST(k % 7 AS VARCHAR) AS value FROM {_TASKS}")
def task_unknown_fields(spark, sf_dir):
    return _tasks(spark, sf_dir).select("path", F.explode("unknown_fields").alias("key", "value"))


@registered(f"""SELECT 'orders/' || k || '.md' AS "File", 'Ship order ' || k AS task, due, CAST(k % 7 AS VARCHAR) AS effort FROM {_TASKS} WHERE NOT done AND (due IS NULL OR due >= '1998-01-01') AND k % 7 >= 5 ORDER BY due DESC NULLS FIRST, k LIMIT 100""")
def task_table_where(spark, sf_dir):
    d = pages.task_records(_tasks(spark, sf_dir)).withColumn("order", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    q = notequery.NoteQuery(d, ("order",)).source("#ship", "orders", every=True).compare("completed", "=", False).compare("due", ">=", "1998-01-01").compare("effort", ">=", "5")
    return q.sort("-due").limit(100).show("task", "due", "effort").run(file_link="file.link").rows


@registered(f"SELECT repeat, count(*) AS n, CASE WHEN repeat IS NULL THEN 'none' WHEN repeat = 'weekly' THEN 'parse-error' ELSE 'supported' END AS status FROM {_TASKS} GROUP BY repeat")
def repeat_status(spark, sf_dir):
    return _tasks(spark, sf_dir).groupBy("repeat").agg(F.count("*").alias("n")).withColumn("status", T.repeat_status(F.col("repeat")))


@registered(f"SELECT k FROM (SELECT 'orders/' || k || '.md' AS k, done FROM {_TASKS}) WHERE NOT done")
def task_open(spark, sf_dir):
    return views.open_tasks(_tasks(spark, sf_dir)).select(F.col("path").alias("k"))


@registered(f"SELECT 'orders/' || k || '.md' AS path, repeat FROM {_TASKS} WHERE NOT done AND repeat IS NOT NULL")
def task_repeat(spark, sf_dir):
    return views.repeating(_tasks(spark, sf_dir)).select("path", "repeat")


def _expanded_sql(start: str, end: str) -> str:
    """Source rows and later occurrences: by the scheduled date where there is one."""
    return f"""(WITH t AS (SELECT *, CAST(coalesce(due, scheduled) AS DATE) AS ref, CASE repeat WHEN 'every week' THEN 7 WHEN 'every 3 days' THEN 3 END AS step,
  CASE WHEN due IS NOT NULL AND scheduled IS NOT NULL THEN 3 ELSE 0 END AS shift FROM {_TASKS}),
 g AS (SELECT *, CAST(unnest(generate_series(ref + step, DATE '{end}' - shift, to_days(CAST(step AS INTEGER)))) AS DATE) AS day_ FROM t WHERE NOT done AND step IS NOT NULL AND ref IS NOT NULL)
 SELECT k, due, scheduled, done FROM t UNION ALL
 SELECT k, CASE WHEN due IS NOT NULL THEN strftime(day_, '%Y-%m-%d') END, CASE WHEN scheduled IS NOT NULL THEN strftime(day_ + shift, '%Y-%m-%d') END, false FROM g WHERE day_ + shift >= DATE '{start}')"""


@registered(f"SELECT 'orders/' || k || '.md' AS path, due, scheduled, done FROM {_expanded_sql('1998-07-01', '1998-07-20')}")
def recur_all_in_window(spark, sf_dir):
    return T.expand_in_window(_tasks(spark, sf_dir), "1998-07-01", "1998-07-20").select("path", "due", "scheduled", "done")


@registered(f"SELECT 'orders/' || k || '.md' AS path, due, scheduled FROM {_expanded_sql('1998-07-06', '1998-07-06')} WHERE NOT done AND (due = '1998-07-06' OR scheduled = '1998-07-06')")
def task_today(spark, sf_dir):
    return views.on_day(_tasks(spark, sf_dir), "1998-07-06").select("path", "due", "scheduled")


@registered(f"SELECT 'orders/' || k || '.md' AS path, due, scheduled FROM {_expanded_sql('1998-07-06', '1998-07-12')} WHERE NOT done AND (due BETWEEN '1998-07-06' AND '1998-07-12' OR scheduled BETWEEN '1998-07-06' AND '1998-07-12')")
def task_week(spark, sf_dir):
    return views.in_week(_tasks(spark, sf_dir), "1998-07-06").select("path", "due", "scheduled")


_LATEST = f"""(WITH t AS (SELECT *, CAST(coalesce(due, scheduled) AS DATE) AS ref, CASE repeat WHEN 'every week' THEN 7 WHEN 'every 3 days' THEN 3 END AS step,
  CASE WHEN due IS NOT NULL AND scheduled IS NOT NULL THEN 3 ELSE 0 END AS shift FROM {_TASKS}),
 m AS (SELECT *, CASE WHEN NOT done AND step IS NOT NULL AND ref IS NOT NULL AND DATE '1996-03-01' >= ref + step THEN ref + CAST(floor((DATE '1996-03-01' - ref) / step) * step AS INTEGER) END AS day_ FROM t)
 SELECT k, done, CASE WHEN day_ IS NOT NULL AND due IS NOT NULL THEN strftime(day_, '%Y-%m-%d') ELSE due END AS due, CASE WHEN day_ IS NOT NULL AND scheduled IS NOT NULL THEN strftime(day_ + shift, '%Y-%m-%d') ELSE scheduled END AS scheduled FROM m)"""


@registered(f"SELECT 'orders/' || k || '.md' AS path, due, scheduled, done FROM {_LATEST}")
def recur_latest(spark, sf_dir):
    return T.latest_on_or_before(_tasks(spark, sf_dir), "1996-03-01").select("path", "due", "scheduled", "done")


@registered(f"SELECT 'orders/' || k || '.md' AS path, due, scheduled FROM {_LATEST} WHERE NOT done AND due <= '1996-03-01'")
def task_due(spark, sf_dir):
    return views.due_by(_tasks(spark, sf_dir), "1996-03-01").select("path", "due", "scheduled")


@registered(f"SELECT 'orders/' || k || '.md' AS path, due FROM {_LATEST} WHERE NOT done AND due <= '1996-03-01'")
def task_overdue(spark, sf_dir):
    return views.overdue(_tasks(spark, sf_dir), "1996-03-01").select("path", "due")


def _early_tasks(spark, sf_dir):
    """Tasks scheduled before they are due, after it, on it, or not at all, each of them weekly."""
    k, day = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd")
    early = F.when(k % 4 < 3, F.concat(F.lit(" [scheduled:: "), day(F.date_add("o_orderdate", ((k % 4) - 1).cast("int") * 9)), F.lit("]"))).otherwise("")
    body = F.concat(F.lit("- [ ] Early #task [due:: "), day("o_orderdate"), F.lit("]"), early, F.lit(" [repeat:: every week]"))
    return T.tasks(spread(table(spark, sf_dir, "orders")).select(F.format_string("o/%d.md", "o_orderkey").alias("path"), body.alias("contents")))


_EARLY = """(SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS ref, CASE WHEN o_orderkey % 4 < 3 THEN CAST((o_orderkey % 4 - 1) * 9 AS INTEGER) END AS shift,
 CAST(floor((DATE '1996-03-01' - CAST(o_orderdate AS DATE)) / 7) AS INTEGER) AS weeks FROM orders)"""


@registered(f"""SELECT 'o/' || k || '.md' AS path, strftime(d, '%Y-%m-%d') AS due, strftime(d + shift, '%Y-%m-%d') AS scheduled, strftime(d, '%Y-%m-%d') AS due_field FROM (SELECT *, ref + 7 * CASE WHEN weeks > 0 THEN weeks ELSE 0 END AS d FROM {_EARLY})""")
def recur_latest_offsets(spark, sf_dir):
    return T.latest_on_or_before(_early_tasks(spark, sf_dir), "1996-03-01").select("path", "due", "scheduled", F.try_element_at("fields", F.lit("due")).alias("due_field"))


@registered(f"""SELECT 'o/' || k || '.md' AS path, strftime(ref + 7 * CASE WHEN weeks > 0 THEN weeks ELSE 0 END, '%Y-%m-%d') AS due FROM {_EARLY} WHERE ref <= DATE '1996-03-01'""")
def task_query_due_by(spark, sf_dir):
    return views.TaskQuery(_early_tasks(spark, sf_dir)).by("1996-03-01").where(~F.col("done")).records().select("path", "due")


@registered("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS ref, o_orderkey % 3 AS r FROM orders), days AS (SELECT k, ref, r, CAST(unnest(generate_series(ref + 1, ref + 70, INTERVAL 1 DAY)) AS DATE) AS day FROM o)
SELECT k, strftime(day, '%Y-%m-%d') AS day FROM days WHERE (r = 0 AND isodow(day) IN (1, 5)) OR (r = 1 AND day(day) IN (1, 15)) OR (r = 2 AND isodow(day) = 3 AND date_diff('week', date_trunc('week', ref), date_trunc('week', day)) % 2 = 0)""")
def recur_named_days(spark, sf_dir):
    k, ref = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    repeat = F.when(k % 3 == 0, "every monday and friday").when(k % 3 == 1, "every month on the 1st and 15th").otherwise("Every other week on Wednesday")
    d = table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(T.occurrences(repeat, ref, F.date_add(ref, 70))).alias("day"))
    return d.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"))


# Checks.


def _linked_notes(spark, sf_dir):
    """Supplier notes (some under one name in two folders, some archived, some with a title of their own) and part notes that link to them."""
    sup = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("k"))
    first = sup.select(F.format_string("a/sup-%d.md", "k").alias("path"), F.format_string("# %s %d\n\ntext", F.when(F.col("k") % 4 == 0, "Shared").otherwise("Sup"), F.when(F.col("k") % 4 == 0, F.col("k") % 16).otherwise(F.col("k"))).alias("contents"))
    twin = sup.where("k % 10 = 0").select(F.format_string("b/sup-%d.md", "k").alias("path"), F.format_string("---\ntitle: Twin\n---\n# Twin %d", "k").alias("contents"))
    old = sup.where("k % 8 = 4").select(F.format_string("Archive/old-%d.md", "k").alias("path"), F.format_string("# Shared %d", F.col("k") % 16).alias("contents"))
    parts = spread(table(spark, sf_dir, "part")).select(
        F.format_string("a/parts/%d.md", "p_partkey").alias("path"),
        F.format_string("# %d\n[[sup-%d]]\n[[../sup-%d]] `[[sup-x]]`", "p_partkey", F.col("p_partkey") % 120, F.col("p_partkey") % 50).alias("contents"),
    )
    return first.unionByName(twin).unionByName(old).unionByName(parts)


_SUPS = "(SELECT s_suppkey AS s FROM supplier)"


@registered(f"""WITH n AS (SELECT count(*) AS n FROM supplier), l AS (SELECT p_partkey AS p, p_partkey % 120 AS t, p_partkey % 50 AS r FROM part), s AS {_SUPS}
SELECT 'error' AS severity, 'a/parts/' || p || '.md' AS path, 2 AS line, 'Broken link: [[sup-' || t || ']]' AS message, '' AS related FROM l WHERE t NOT IN (SELECT s FROM s)
UNION ALL SELECT 'error', 'a/parts/' || p || '.md', 3, 'Broken link: [[../sup-' || r || ']]', '' FROM l WHERE r NOT IN (SELECT s FROM s)
UNION ALL SELECT 'warning', 'a/parts/' || p || '.md', 2, 'Ambiguous link: [[sup-' || t || ']]', 'a/sup-' || t || '.md,b/sup-' || t || '.md' FROM l WHERE t IN (SELECT s FROM s) AND t % 10 = 0""")
def check_links(spark, sf_dir):
    notes = checks.parsed_once(_linked_notes(spark, sf_dir), "headings", "links")
    return checks.with_related_paths(checks.check_links(notes), checks.link_paths(notes)).select("severity", "path", "line", "message", F.array_join("related_paths", ",").alias("related"))


@registered(f"""WITH h AS (SELECT s, s % 16 AS g FROM {_SUPS} WHERE s % 4 = 0), g AS (SELECT g, list('a/sup-' || s || '.md' ORDER BY 'a/sup-' || s || '.md') AS paths FROM h GROUP BY g HAVING count(*) > 1)
SELECT 'a/sup-' || s || '.md' AS path, 'Duplicate heading: Shared ' || g AS message, array_to_string(list_filter(paths, lambda x: x <> 'a/sup-' || s || '.md'), ',') AS related FROM h JOIN g USING (g)""")
def check_duplicate_h1(spark, sf_dir):
    notes = checks.parsed_once(_linked_notes(spark, sf_dir), "headings")
    return checks.with_related_paths(checks.check_duplicate_headings(notes), checks.heading_paths(notes)).select("path", "message", F.array_join("related_paths", ",").alias("related"))


@registered(f"""WITH a AS (SELECT s % 16 AS g, 'a/sup-' || s || '.md' AS path FROM {_SUPS} WHERE s % 4 = 0), o AS (SELECT s % 16 AS g, 'Archive/old-' || s || '.md' AS path FROM {_SUPS} WHERE s % 8 = 4),
ag AS (SELECT g, string_agg(path, ',' ORDER BY path) AS r FROM a GROUP BY g), og AS (SELECT g, string_agg(path, ',' ORDER BY path) AS r FROM o GROUP BY g)
SELECT path, 'Heading also in archive: Shared ' || g AS message, r AS related FROM a JOIN og USING (g) UNION ALL SELECT path, 'Heading also in archive: Shared ' || g, r FROM o JOIN ag USING (g)""")
def check_archive_collision(spark, sf_dir):
    notes = checks.parsed_once(_linked_notes(spark, sf_dir), "headings")
    return checks.with_related_paths(checks.check_archive_headings(notes), checks.archive_heading_paths(notes)).select("path", "message", F.array_join("related_paths", ",").alias("related"))


@registered(f"""SELECT 'a/sup-' || s || '.md' AS path, 'Heading differs from file name: ' || CASE WHEN s % 4 = 0 THEN 'Shared ' || (s % 16) ELSE 'Sup ' || s END AS message FROM {_SUPS}
UNION ALL SELECT 'b/sup-' || s || '.md', unnest(['Heading differs from file name: Twin ' || s, 'Title differs from file name: Twin']) FROM {_SUPS} WHERE s % 10 = 0
UNION ALL SELECT 'Archive/old-' || s || '.md', 'Heading differs from file name: Shared ' || (s % 16) FROM {_SUPS} WHERE s % 8 = 4""")
def check_title_drift(spark, sf_dir):
    return checks.check_titles(_linked_notes(spark, sf_dir)).select("path", "message")


@registered("SELECT 'n' || n_nationkey || '/dump.md' AS path, 4 AS line FROM nation WHERE n_nationkey % 2 = 0")
def check_dump(spark, sf_dir):
    path = F.concat(F.lit("n"), "n_nationkey", F.lit("/dump.md"))
    d = table(spark, sf_dir, "nation").select(path.alias("path"), F.concat(F.lit("---\na: b\n---\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("left here: "), "n_name")).otherwise("# Empty")).alias("contents"))
    return checks.check_dump(d).select("path", "line")


def _flawed_tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit("- ["), F.when(k % 2 == 0, "x").otherwise(" "), F.lit("] Do "), k, F.lit(" #task"), F.when(k % 3 == 0, " [due:: 2026-02-29]").otherwise(" [due:: 2026-03-01]"), F.when(k % 5 == 0, " [completed:: 2026-01-01]").otherwise(""),
        F.when(k % 7 == 0, " [scheduled:: 2026-04-01]").otherwise(""), F.when(k % 4 == 1, " [area:: Sales]").otherwise(" [area:: [[Sales]]]"), F.lit(" [project:: [[P]]]"), F.when(k % 6 == 0, " [priority:: urgent]").otherwise(" [priority:: High]"), F.when(k % 9 == 0, " [size:: 3]").otherwise(""),
    )
    return T.tasks(spread(table(spark, sf_dir, "orders")).select(F.format_string("o/%d.md", "o_orderkey").alias("path"), body.alias("contents")))


@registered("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS done FROM orders), f AS (
SELECT k, 'error' AS severity, 'Invalid due date: 2026-02-29' AS message FROM o WHERE k % 3 = 0
UNION ALL SELECT k, 'error', 'Done task without a completed date' FROM o WHERE done AND k % 5 <> 0
UNION ALL SELECT k, 'error', 'Open task with a completed date' FROM o WHERE NOT done AND k % 5 = 0
UNION ALL SELECT k, 'warning', 'Open task without a date' FROM o WHERE NOT done AND k % 3 = 0 AND k % 7 <> 0
UNION ALL SELECT k, 'warning', 'Scheduled after due' FROM o WHERE NOT done AND k % 7 = 0 AND k % 3 <> 0
UNION ALL SELECT k, 'warning', 'area is no link: Sales' FROM o WHERE k % 4 = 1
UNION ALL SELECT k, 'warning', 'Unknown priority: urgent' FROM o WHERE k % 6 = 0
UNION ALL SELECT k, 'warning', 'Unknown field: size' FROM o WHERE k % 9 = 0)
SELECT 'o/' || k || '.md' AS path, 1 AS line, severity, message FROM f""")
def check_task_metadata(spark, sf_dir):
    return checks.check_tasks(_flawed_tasks(spark, sf_dir)).select("path", "line", "severity", "message")


@registered("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 <> 0 AS done, strftime(o_orderdate, '%Y-%m-%d') AS due FROM orders),
s AS (SELECT c, max(due) FILTER (done) AS d, max(due) FILTER (NOT done) AS p FROM o GROUP BY c)
SELECT 'o/' || k || '.md' AS path, 'Repeating task has no later open task: Call ' || c AS message FROM o JOIN s USING (c) WHERE done AND due = d AND (p IS NULL OR p <= d)""")
def check_recur_seed(spark, sf_dir):
    body = F.concat(
        F.lit("- ["), F.when(F.col("o_orderkey") % 3 != 0, "x").otherwise(" "), F.lit("] Call "), "o_custkey", F.lit(" #task [repeat:: every month] [due:: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("]")
    )
    d = T.tasks(spread(table(spark, sf_dir, "orders")).select(F.format_string("o/%d.md", "o_orderkey").alias("path"), body.alias("contents")))
    return checks.check_repeat_seeds(d).select("path", "message")


@registered("SELECT count(*) FILTER (o_orderkey % 3 = 0) + count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0) + count(*) FILTER (o_orderkey % 2 = 1 AND o_orderkey % 5 = 0) AS errors, true AS failed FROM orders")
def check_summary(spark, sf_dir):
    return checks.summary(checks.check_tasks(_flawed_tasks(spark, sf_dir))).select("errors", "failed")


@registered("""SELECT kind, path, text FROM (
SELECT 'note' AS kind, 'parts/' || p_partkey || '.md' AS path, CAST(p_partkey AS VARCHAR) AS text, 'parts/' || p_partkey || '.md' AS hay FROM part
UNION ALL SELECT 'heading', path, text, text FROM """ + _HEADINGS + """
UNION ALL SELECT 'link', 'parts/' || p_partkey || '.md', unnest(['the supplier', p_brand, 'Ann']), unnest(['the supplier|terms|supplier-' || (p_partkey % 10), p_brand, 'Ann']) FROM part
UNION ALL SELECT 'tag', 'parts/' || p_partkey || '.md', t, t FROM (SELECT p_partkey, '#brand/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS t FROM part))
WHERE contains(lower(hay), 'r-1') OR contains(lower(hay), 'r-1')""")
def vault_search(spark, sf_dir):
    return search.search_notes(_part_notes(spark, sf_dir), "R-1").select("kind", "path", "text")


@registered("SELECT '| ' || n_nationkey || ' | ' || n_name || ' | a\\|b<br>c |' AS line FROM nation")
def render_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit("a|b\nc").alias("odd"))
    return render.markdown_lines(d)


@registered("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","none":null}' AS line FROM region""")
def render_json(spark, sf_dir):
    return render.json_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none")))


# Checks of chosen notes, of notes that can't be read, and of series.


@registered(f"""WITH s AS {_SUPS} SELECT 'a/parts/' || p || '.md' AS path, 'Broken link: [[sup-' || t || ']]' AS message FROM (SELECT p_partkey AS p, p_partkey % 120 AS t FROM part) WHERE p % 3 = 0 AND t NOT IN (SELECT s FROM s)
UNION ALL SELECT 'a/parts/' || p || '.md', 'Broken link: [[../sup-' || r || ']]' FROM (SELECT p_partkey AS p, p_partkey % 50 AS r FROM part) WHERE p % 3 = 0 AND r NOT IN (SELECT s FROM s)
UNION ALL SELECT 'a/parts/' || p || '.md', 'Ambiguous link: [[sup-' || t || ']]' FROM (SELECT p_partkey AS p, p_partkey % 120 AS t FROM part) WHERE p % 3 = 0 AND t IN (SELECT s FROM s) AND t % 10 = 0""")
def check_chosen_links(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.format_string("./a/parts/%d.md", "p_partkey").alias("path"))
    return checks.bundle("links").run(_linked_notes(spark, sf_dir), chosen).select("path", "message")


def _broken_notes(spark, sf_dir):
    k = F.col("s_suppkey")
    contents = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("---\nno key here\n---\n[[gone]] "), k)).when(k % 5 == 2, "---\na: b\n\tc: d\n---\ntext").otherwise(F.concat(F.lit("---\na: [b]\nc:\n  - d\n---\n[[gone]] "), k))
    return table(spark, sf_dir, "supplier").select(F.format_string("b/%d.md", "s_suppkey").alias("path"), contents.alias("contents"))


@registered("""SELECT 'catalog' AS category, 'b/' || s_suppkey || '.md' AS path, CASE s_suppkey % 5 WHEN 0 THEN 'The note has no contents' ELSE 'The frontmatter is no list of keys and values' END AS message FROM supplier WHERE s_suppkey % 5 < 3
UNION ALL SELECT 'links', 'b/' || s_suppkey || '.md', 'Broken link: [[gone]]' FROM supplier WHERE s_suppkey % 5 > 2""")
def check_unreadable_notes(spark, sf_dir):
    return checks.CheckSet((checks.CHECKS["failures"], checks.CHECKS["links"])).run(_broken_notes(spark, sf_dir)).select("category", "path", "message")


@registered("""WITH f AS (SELECT CASE WHEN s_suppkey % 5 < 3 THEN 'catalog' ELSE 'links' END AS category, 'b/' || s_suppkey || '.md' AS path FROM supplier)
SELECT category, count(*) AS n, row_number() OVER (ORDER BY min(path)) - 1 AS ord FROM f GROUP BY category""")
def check_categories(spark, sf_dir):
    return checks.categories(checks.CheckSet((checks.CHECKS["failures"], checks.CHECKS["links"])).run(_broken_notes(spark, sf_dir)))


def _series_notes(spark, sf_dir):
    """Completed tasks whose only date is their completion, or that are due, or scheduled; open ones of one shape only."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    dated = F.when(k % 3 == 0, F.concat(F.lit(" [completed:: "), day, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit(" [due:: "), day, F.lit("]"))).otherwise(F.concat(F.lit(" [scheduled:: "), day, F.lit("]")))
    done = (k % 3 == 0) | (k % 5 > 0)
    area = F.when(k % 2 == 0, " [area:: ]").otherwise("")
    body = F.concat(F.lit("- ["), F.when(done, "x").otherwise(" "), F.lit("] Pay "), "o_custkey", F.lit(" #task [repeat::  every week ]"), area, dated)
    return table(spark, sf_dir, "orders").select(F.format_string("o/%d.md", "o_orderkey").alias("path"), body.alias("contents"))


@registered("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 1 THEN 'due' ELSE 'scheduled' END AS shape, o_orderkey % 3 = 0 OR o_orderkey % 5 > 0 AS done FROM orders),
s AS (SELECT c, shape, max(day) FILTER (done) AS d, max(day) FILTER (NOT done) AS p FROM o GROUP BY ALL)
SELECT 'o/' || k || '.md' AS path FROM o JOIN s USING (c, shape) WHERE done AND day = d AND (p IS NULL OR p <= d)""")
def check_recur_series(spark, sf_dir):
    return checks.check_repeat_seeds(T.tasks(_series_notes(spark, sf_dir))).select("path")


# Typed frontmatter.


def _typed_notes(spark, sf_dir):
    """Frontmatter with block lists, a nested map, quoted and folded text, numbers and a comment."""
    k = F.col("p_partkey").cast("string")
    return spread(table(spark, sf_dir, "part")).select(
        F.format_string("t/%d.md", "p_partkey").alias("path"),
        F.concat_ws(
            "\n", F.lit("---"), F.concat(F.lit("name: \""), "p_name", F.lit(": it\"")), F.concat(F.lit("size: "), "p_size", F.lit("  # in inches")), F.concat(F.lit("half: "), "p_size", F.lit(".5")), F.lit("tags:\n- part\n-   shop/tool"),
            F.concat(F.lit("maker:\n  brand: "), "p_brand", F.lit("\n  lines:\n    - id: "), k, F.lit("\n      open: true\n    - {id: 2, open: no}\n  last: ~")), F.concat(F.lit("about: >-\n  folded "), "p_type", F.lit("\n  text\n\n  end")),
            F.lit("links: [[[Home]], 'it''s']\n---"), F.concat(F.lit("body "), k, F.lit(" #"), F.lit("body")),
        ).alias("contents"),
    )


@registered("""SELECT 't/' || p_partkey || '.md' AS path, unnest(range(7)) AS ord, unnest(['name', 'size', 'half', 'tags', 'maker', 'about', 'links']) AS key, unnest([
  '"' || p_name || ': it"', CAST(p_size AS VARCHAR), p_size || '.5', '["part","shop/tool"]',
  '{"brand":"' || p_brand || '","last":null,"lines":[{"id":' || p_partkey || ',"open":true},{"id":2,"open":"no"}]}', '"folded ' || p_type || ' text\\nend"', '[[["Home"]],"it''s"]']) AS value FROM part""")
def front_typed_values(spark, sf_dir):
    return M.frontmatter_values(_typed_notes(spark, sf_dir)).select("path", F.col("ord").cast("long").alias("ord"), "key", F.to_json("value").alias("value"))


@registered("""SELECT 't/' || p_partkey || '.md' AS "File", CAST(p_size AS VARCHAR) AS size, p_brand AS brand FROM part WHERE p_size >= 7 AND p_size + 0.5 < 30 AND p_brand <> 'Brand#11' ORDER BY p_size DESC, p_partkey LIMIT 400""")
def page_typed_where(spark, sf_dir):
    d = pages.page_records(_typed_notes(spark, sf_dir)).withColumn("order", F.regexp_extract("`file.path`", r"(\d+)", 1).cast("long"))
    q = notequery.NoteQuery(d, ("order",)).source("#shop/tool").compare("size", ">=", 7).compare("half", "<", 30).compare("maker.brand", "!=", "Brand#11").sort("-size").limit(400)
    return q.show(size=V.head(q.term("size")), brand=V.head(q.term("maker.brand"))).run(file_link="file.link").rows


@registered("SELECT 't/' || p_partkey || '.md' AS path, '#part #shop/tool #body' AS etags, '#part #shop #shop/tool #body' AS tags FROM part")
def tags_from_block_lists(spark, sf_dir):
    return M.note_tags(_typed_notes(spark, sf_dir)).select("path", F.array_join("etags", " ").alias("etags"), F.array_join("tags", " ").alias("tags"))


def _odd_front_notes(spark, sf_dir):
    k = F.col("s_suppkey")
    front = (
        F.when(k % 6 == 0, "a: \"open").when(k % 6 == 1, "a: b\n  c: d").when(k % 6 == 2, "a: 1\na: 2").when(k % 6 == 3, "a:\n  - b\n c: d").when(k % 6 == 4, "- a\n- b")
        .otherwise("# nothing\na: |\n  no key: here\n   \"open\nb: 'c'")
    )
    return table(spark, sf_dir, "supplier").select(F.format_string("y/%d.md", k).alias("path"), F.concat(F.lit("---\n"), front, F.lit("\n---\n")).alias("contents"))


@registered("SELECT 'y/' || s_suppkey || '.md' AS path FROM supplier WHERE s_suppkey % 6 < 4")
def unreadable_frontmatter(spark, sf_dir):
    return vault.failures(_odd_front_notes(spark, sf_dir)).select("path")


# Containers, masks, brackets and places.


def _nested_notes(spark, sf_dir):
    """Quotes, nested items, HTML, a table, nested brackets, and text marked over line ends."""
    k = F.col("c_custkey").cast("string")
    return spread(table(spark, sf_dir, "customer")).select(
        F.concat(F.lit("n/"), k, F.lit(".md")).alias("path"),
        F.concat_ws(
            "\n", F.concat(F.lit("> # Quoted "), k), F.concat(F.lit("> - [ ] call [["), "c_name", F.lit("]] #task [due:: 2026-01-02]")), F.lit(">   - nested **marked\n>     on** more\n>"),
            F.lit("> ```sql\n> select 1 # no #tag\n> ```\n"), F.concat(F.lit("1. first\n\n   ## Inner "), k), F.lit("   - deep `a\n     [[hidden]] b` [[Seen|x]]"),
            F.concat(F.lit("\n<!-- [[gone]] #gone\nstill [[gone]] -->\n| [[T"), k, F.lit("\\|al]] | #cell |")), F.lit("<div>\n#html [[html]]\n</div>\n"),
            F.concat(F.lit("Text <a href=\"#no\"> [k:: a (b) c] (z:: [[L"), k, F.lit("]] (in) [q]) [a:: [b:: c]] #end")), F.lit("<b>#bold</b> ![[P [x]|y [z]]]"),
        ).alias("contents"),
    )


@registered("SELECT 'n/' || c_custkey || '.md' AS path, unnest([1, 12]) AS line, unnest([1, 2]) AS depth, unnest(['Quoted ' || c_custkey, 'Inner ' || c_custkey]) AS text FROM customer")
def headings_in_containers(spark, sf_dir):
    return M.headings(_nested_notes(spark, sf_dir)).drop("source")


@registered("""SELECT 'n/' || c_custkey || '.md' AS path, unnest([2, 3, 10, 13]) AS line, unnest([2, 4, 0, 3]) AS indent, unnest([false, NULL, NULL, NULL]) AS checked, unnest(['call ' || c_name || ' #task 2026-01-02', 'nested marked', 'first', 'deep a']) AS text FROM customer""")
def items_in_containers(spark, sf_dir):
    return M.list_items(_nested_notes(spark, sf_dir)).select("path", "line", "indent", "checked", "text")


@registered("SELECT 'n/' || c_custkey || '.md' AS path, 2 AS line, 'call ' || c_name AS text, '2026-01-02' AS due, false AS done FROM customer")
def tasks_in_containers(spark, sf_dir):
    return T.tasks(_nested_notes(spark, sf_dir)).select("path", "line", "text", "due", "done")


@registered("SELECT 'n/' || c_custkey || '.md' AS path, 6 AS line, 'sql' AS language, 'select 1 # no #tag' AS value FROM customer")
def code_in_containers(spark, sf_dir):
    return M.code_blocks(_nested_notes(spark, sf_dir)).select("path", "line", "language", "value")


@registered("""SELECT 'n/' || c_custkey || '.md' AS path, unnest([2, 14, 18, 23, 24]) AS line, unnest([14, 20, 3, 40, 14]) AS col, unnest([split_part(c_name, '#', 1), 'Seen', 'T' || c_custkey, 'L' || c_custkey, 'P [x]']) AS target,
 unnest([NULL, 'x', 'al', NULL, 'y [z]']) AS alias, unnest([false, false, false, false, true]) AS embed FROM customer""")
def links_with_places(spark, sf_dir):
    return M.links(_nested_notes(spark, sf_dir)).select("path", "line", F.col("column").alias("col"), "target", "alias", "embed")


@registered("SELECT 'n/' || c_custkey || '.md' AS path, unnest([2, 18, 23, 24]) AS line, unnest([19 + length(c_name), 15 + length(CAST(c_custkey AS VARCHAR)), 70 + length(CAST(c_custkey AS VARCHAR)), 4]) AS col, unnest(['#task', '#cell', '#end', '#bold']) AS value FROM customer")
def tags_with_places(spark, sf_dir):
    return M.tags(_nested_notes(spark, sf_dir)).select("path", "line", F.col("column").alias("col"), "value")


@registered("SELECT 'n/' || c_custkey || '.md' AS path, unnest([2, 23, 23]) AS line, unnest(['due', 'k', 'z']) AS key, unnest(['2026-01-02', 'a (b) c', '[[L' || c_custkey || ']] (in) [q]']) AS value FROM customer")
def fields_with_brackets(spark, sf_dir):
    return M.inline_fields(_nested_notes(spark, sf_dir)).select("path", "line", "key", "value")


# Ordinal and bounded repeats, whole task rows.


def _ordinal_tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    repeat = F.when(k % 4 == 0, "every month on the 2nd Friday").when(k % 4 == 1, "every month on the last friday").when(k % 4 == 2, "every 2 weeks on monday for 3 times").otherwise("every month until June 15, 1996")
    body = F.concat(F.lit("- [ ] Visit "), k, F.lit(" #task [due:: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("] [repeat:: "), repeat, F.lit("]"))
    return T.tasks(table(spark, sf_dir, "orders").select(F.format_string("r/%d.md", k).alias("path"), body.alias("contents")))


@registered("""WITH days AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d0 FROM orders),
hit AS (SELECT k, d0, d, k % 4 AS kind FROM o JOIN days ON d >= d0 AND CASE k % 4
  WHEN 0 THEN dayofweek(d) = 5 AND day(d) BETWEEN 8 AND 14 WHEN 1 THEN dayofweek(d) = 5 AND month(d + INTERVAL 7 DAY) <> month(d)
  WHEN 2 THEN dayofweek(d) = 1 AND (datediff('day', date_trunc('week', d0), date_trunc('week', d)) // 7) % 2 = 0 ELSE day(d) = day(d0) AND d <= DATE '1996-06-15' END),
counted AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM hit)
SELECT 'r/' || k || '.md' AS path, strftime(d, '%Y-%m-%d') AS due FROM counted WHERE d > d0 AND d >= DATE '1996-01-01' AND (kind <> 2 OR i <= 3)""")
def recur_ordinal_in_window(spark, sf_dir):
    return T.expand_in_window(_ordinal_tasks(spark, sf_dir), "1996-01-01", "1996-12-31").where("occurrence > 0").select("path", "due")


@registered(f"""SELECT 'orders/' || k || '.md' AS "File", 'Ship order ' || k AS task, 'Ship order ' || k AS text, done AS completed, due, scheduled, repeat, '[[Sales]]' AS area, CAST(NULL AS VARCHAR) AS project, CAST(NULL AS VARCHAR) AS depends,
 CAST(NULL AS VARCHAR) AS "repeatFrom", '#task,#ship' AS tags, 'orders/' || k || '.md' AS path, 4 AS line, CAST(k % 7 AS VARCHAR) AS effort FROM {_TASKS}""")
def task_rows_whole(spark, sf_dir):
    d = pages.task_records(_tasks(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))
    q = notequery.NoteQuery(d, ("path", "line"))
    return q.show("task", "text", "completed", "due", "scheduled", "repeat", "area", "project", "depends", "repeatFrom", "tags", "path", "line", "effort").run(file_link="file.link").rows


# Findings with counts and keys, and the paths of keys as rows: nothing grows with a group.


@registered(f"""WITH l AS (SELECT p_partkey AS p, p_partkey % 120 AS t, p_partkey % 50 AS r FROM part), s AS {_SUPS}
SELECT 'a/parts/' || p || '.md' AS path, 2 AS line, CAST(0 AS BIGINT) AS n_related, CAST(NULL AS VARCHAR) AS related_key FROM l WHERE t NOT IN (SELECT s FROM s)
UNION ALL SELECT 'a/parts/' || p || '.md', 3, 0, NULL FROM l WHERE r NOT IN (SELECT s FROM s)
UNION ALL SELECT 'a/parts/' || p || '.md', 2, 2, 'sup-' || t FROM l WHERE t IN (SELECT s FROM s) AND t % 10 = 0""")
def check_links_by_key(spark, sf_dir):
    return checks.check_links(_linked_notes(spark, sf_dir)).select("path", "line", "n_related", "related_key")


@registered(f"SELECT 'sup-' || s AS key, unnest(['a/sup-' || s || '.md', 'b/sup-' || s || '.md']) AS path FROM {_SUPS} WHERE s % 10 = 0")
def link_key_paths(spark, sf_dir):
    paths = checks.link_paths(_linked_notes(spark, sf_dir)).where(~F.contains("key", F.lit("/")))
    return paths.join(paths.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 and key like 'sup-%'"), "key").select("key", "path")


@registered(f"""WITH h AS (SELECT s, s % 16 AS g FROM {_SUPS} WHERE s % 4 = 0)
SELECT 'a/sup-' || s || '.md' AS path, 'shared ' || g AS related_key, count(*) OVER (PARTITION BY g) - 1 AS n_related FROM h QUALIFY count(*) OVER (PARTITION BY g) > 1""")
def duplicate_headings_by_key(spark, sf_dir):
    return checks.check_duplicate_headings(_linked_notes(spark, sf_dir)).select("path", "related_key", "n_related")


@registered(f"""WITH a AS (SELECT s % 16 AS g, 'a/sup-' || s || '.md' AS path FROM {_SUPS} WHERE s % 4 = 0), o AS (SELECT s % 16 AS g, 'Archive/old-' || s || '.md' AS path FROM {_SUPS} WHERE s % 8 = 4),
na AS (SELECT g, count(*) AS n FROM a GROUP BY g), nb AS (SELECT g, count(*) AS n FROM o GROUP BY g)
SELECT path, 'old:shared ' || g AS related_key, n AS n_related FROM a JOIN nb USING (g) UNION ALL SELECT path, 'new:shared ' || g, n FROM o JOIN na USING (g)""")
def archive_headings_by_key(spark, sf_dir):
    return checks.check_archive_headings(_linked_notes(spark, sf_dir)).select("path", "related_key", "n_related")


# A window that any dated condition of a task query gives.


@registered("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d0 FROM orders WHERE o_orderkey % 4 = 1),
days AS (SELECT CAST(unnest(generate_series(DATE '1996-03-01', DATE '1996-03-31', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT 'r/' || k || '.md' AS path, strftime(d, '%Y-%m-%d') AS due FROM o JOIN days ON d > d0 AND dayofweek(d) = 5 AND month(d + INTERVAL 7 DAY) <> month(d)
UNION ALL SELECT 'r/' || k || '.md', strftime(d0, '%Y-%m-%d') FROM o WHERE d0 BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'""")
def recur_last_fridays_within(spark, sf_dir):
    some = _ordinal_tasks(spark, sf_dir).where("repeat = 'every month on the last friday'")
    return views.TaskQuery(some).within("1996-03-01", "1996-03-31").records().select("path", "due")
