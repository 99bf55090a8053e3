"""Page and task records: one row for each note or task, with what queries ask of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.frames import held
from ..functions.text import expanded_tags, folder_of, sanitised_key, title_of
from . import markdown as M
from .tasks import KNOWN_FIELDS


def page_records(notes: DataFrame) -> DataFrame:
    """One row for each note: file.path, file.name, file.folder, file.ext, file.link, file.etags, file.tags, file.outlinks, file.frontmatter, values and fields.

    values maps each key, as written and with lower case and hyphens, to its values in order, each a VARIANT: those of the frontmatter with their types, inline
    fields, then 'key:: value' lines that don't repeat an inline field; fields has the same values as texts.  A term looks a name up there that is no
    column (functions.values.field).  A note is parsed once and makes its own row, so nothing is shuffled.
    """
    d = held(M.parsed(notes), inline=M.field_records(), bare=M.bare_records(), links=M.link_records(), found=M.tag_records(), json=M.front_json())
    d = d.select("path", "inline", "bare", "links", "found", "json")
    pairs = F.filter(F.map_entries(M.front_pairs(F.col("json"))), lambda p: ~F.is_variant_null(p["value"]))
    d = held(d, pairs=F.coalesce(pairs, F.array().cast("array<struct<key:string,value:variant>>")))
    entry = lambda key, values: F.struct(key.alias("key"), values.alias("values"))
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    front = F.transform("pairs", lambda p: entry(p["key"], F.when(is_list(p["value"]), F.try_variant_get(p["value"], "$", "array<variant>")).otherwise(F.array(p["value"]))))
    written = lambda r: entry(r["key"], F.array(r["value"].cast("variant")))
    new = F.filter("bare", lambda b: ~F.exists("inline", lambda i: (i["key"] == b["key"]) & (i["value"] == b["value"])))
    d = held(d, entries=F.concat(front, F.transform("inline", written), F.transform(new, written)))
    d = held(d, named=F.transform("entries", lambda e: F.struct(F.array_distinct(F.array(e["key"], sanitised_key(e["key"]))).alias("keys"), e["values"].alias("values"))))
    d = held(d, keys=F.array_distinct(F.flatten(F.transform("named", lambda e: e["keys"]))))
    gathered = F.transform("keys", lambda k: F.flatten(F.transform(F.filter("named", lambda e: F.array_contains(e["keys"], k)), lambda e: e["values"])))
    scalars = F.filter("pairs", lambda p: ~F.schema_of_variant(p["value"]).rlike("^(?:ARRAY|OBJECT)"))
    lines = F.transform(scalars, lambda p: F.concat_ws(" | ", p["key"], V.text(V.Term(p["value"], T.VariantType()))))
    etags = F.array_distinct(F.concat(M.front_tags(F.col("json")), F.transform("found", lambda t: t["value"])))
    d = held(d, values=F.map_from_arrays("keys", gathered), etags=etags, outlinks=F.transform("links", lambda x: x["target"]), lines=lines)
    return d.select(
        F.col("path").alias("file.path"), title_of(F.col("path")).alias("file.name"), folder_of(F.col("path")).alias("file.folder"), F.lit("md").alias("file.ext"), F.col("path").alias("file.link"),
        F.col("etags").alias("file.etags"), expanded_tags(F.col("etags")).alias("file.tags"), F.col("outlinks").alias("file.outlinks"), F.col("lines").alias("file.frontmatter"), "values",
        F.transform_values("values", lambda k, v: F.transform(v, lambda x: V.text(V.Term(x, T.VariantType())))).alias("fields"),
    )


def task_records(tasks: DataFrame) -> DataFrame:
    """What queries ask of tasks (of a note or expanded): task and text, completed, dates and known fields as they are or as written, tags, path, line,
    file.path, file.link, file.line, and fields, where a term looks up all others."""
    written = lambda name: F.coalesce(F.col(name), F.try_element_at("fields", F.lit(name))).alias(name)
    return tasks.select(
        "fields", F.col("text").alias("task"), "text", F.col("done").alias("completed"), *[written(k) for k in KNOWN_FIELDS if k != "completed"], "tags", "path", "line",
        F.col("path").alias("file.path"), F.col("path").alias("file.link"), F.col("line").alias("file.line"),
    )
