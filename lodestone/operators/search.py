"""Case-insensitive search over what notes are known by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_of
from . import markdown as M


def search_notes(notes: DataFrame, needle: str) -> DataFrame:
    """(kind, path, line, text) of notes by path and title, headings, links by any part, and tags; an empty needle finds all.  Each note is parsed once."""
    wanted = F.lit(needle.lower())

    def holds(r, *fields):
        found = F.lit(False)
        for f in fields:
            found = found | F.coalesce(F.contains(F.lower(r[f]), wanted), F.lit(False))
        return found

    def hits(column, kind, text, *fields):
        return F.transform(F.filter(column, lambda r: holds(r, *fields)), lambda r: F.struct(F.lit(kind).alias("kind"), r["line"].alias("line"), r[text].alias("text")))

    d = M.extracted(notes, "headings", "links", "tags").withColumn("own_", F.array(F.struct(F.lit(None).cast("int").alias("line"), title_of(F.col("path")).alias("title"), F.col("path").alias("path"))))
    every = F.concat(
        hits("own_", "note", "title", "path", "title"), hits("headings_", "heading", "text", "text"), hits("links_", "link", "value", "value", "target", "alias", "header", "block"), hits("tags_", "tag", "value", "value")
    )
    return d.select("path", F.explode(every).alias("r_")).select("r_.kind", "path", "r_.line", "r_.text")
