"""Collections of Markdown notes as DataFrames (path, contents), and which of their paths a scope or ignore file takes in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import yaml
from ..functions.text import once


def glob_regex(glob: str) -> str:
    """A glob with *, ? and ** as a regular expression for whole paths; leading dots are matched like other characters."""
    out = []
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token))
    return f"^{''.join(out)}$"


def scope_globs(path: str | None) -> list[str]:
    """The globs of a scope: everything for '', '.' or None; a glob or a .md path itself; else all notes below a folder."""
    path = (path or "").removeprefix("./").rstrip("/")
    if path in ("", "."):
        return ["**/*.md"]
    return [path] if re.search(r"[*?]", path) or path.endswith(".md") else [f"{path}/**/*.md"]


def in_scope(path: Column, *scopes: str | None) -> Column:
    globs = [g for s in scopes or (None,) for g in scope_globs(s)]
    matched = F.lit(False)
    for g in globs:
        folder = g.removesuffix("**/*.md")
        if g == "**/*.md":
            matched = matched | path.endswith(".md")
        elif folder != g and not re.search(r"[*?]", folder):
            matched = matched | (path.startswith(folder) & path.endswith(".md"))
        else:
            matched = matched | path.rlike(glob_regex(g))
    return matched


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(negated, regular expression) for each rule of an ignore file."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        negated, rule = line.startswith("!"), line.removeprefix("!").removeprefix("./").removeprefix("/")
        rule = f"{rule}**" if rule.endswith("/") else rule
        rules.append((negated, glob_regex(rule if "/" in rule else f"**/{rule}")))
    return rules


def ignored(path: Column, text: str) -> Column:
    """Whether the last rule that matches a path ignores it."""
    verdict = F.lit(False)
    for negated, rx in ignore_rules(text):
        verdict = F.when(path.rlike(rx), F.lit(not negated)).otherwise(verdict)
    return verdict


def _bytes(spark: SparkSession, file: str) -> bytes | None:
    """The bytes of one file by Hadoop's file system, None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    stream = store.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def ignore_text(spark: SparkSession, root: str) -> str:
    """The text of the ignore file at root, empty where there is none; Spark's own readers skip hidden names."""
    return (_bytes(spark, f"{root}/.kbignore") or b"").decode("utf-8", "replace")


def hidden_notes(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, int]]]:
    """The notes under root that Spark's listing skips, since a name on their path begins with '_' or '.': those in hidden folders, and
    hidden files with their sizes, which no reader of Spark's takes even by their paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store, inside, files = path.getFileSystem(spark._jsc.hadoopConfiguration()), [], []
    base, found = store.getFileStatus(path).getPath().toString(), store.listFiles(path, True)
    while found.hasNext():
        status = found.next()
        file = status.getPath().toString()
        if file.endswith(".md") and re.search(r"/[_.]", file[len(base) :]):
            if re.search(r"/[_.][^/]*$", file):
                files.append((file, status.getLen()))
            else:
                inside.append(file)
    return inside, files


#: Bytes of hidden files that the driver reads at most.
HIDDEN_BYTES = 64 << 20


def read_notes(spark: SparkSession, root: str, scope: str | None = None) -> DataFrame:
    """(path, contents, error) of the notes under root, hidden ones too; an ignore file .kbignore at the root applies.

    Spark's recursive file reader lists all but hidden names.  Notes in hidden folders are read by their paths, and notes whose own names
    are hidden by the driver, up to HIDDEN_BYTES (more are refused).  A note that isn't UTF-8 has null contents and says so in error.
    """
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", "*.md").load(root).select(F.col("path").alias("file"), "content")
    folders, hidden = hidden_notes(spark, root)
    if folders:
        files = files.unionByName(spark.read.format("binaryFile").load(folders).select(F.col("path").alias("file"), "content"))
    if sum(size for _, size in hidden) > HIDDEN_BYTES:
        raise ValueError(f"{len(hidden)} hidden notes hold more than {HIDDEN_BYTES} bytes")
    if hidden:
        files = files.unionByName(spark.createDataFrame([(file, bytearray(_bytes(spark, file))) for file, _ in hidden], "file string, content binary"))
    inside = F.regexp_replace(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), rf"^.*?{re.escape(root)}/", "")
    contents = F.try_validate_utf8(F.col("content").cast("string"))
    notes = files.select(inside.alias("path"), contents.alias("contents"), F.when(contents.isNull(), "The file is not UTF-8 text").alias("error"))
    notes = notes.where(in_scope(F.col("path"), scope))
    return notes.where(~ignored(F.col("path"), ignore_text(spark, root)))


def _error(notes: DataFrame) -> Column:
    """Why a note can't be read; null for sound ones."""
    contents = F.col("contents")
    known = F.col("error") if "error" in notes.columns else F.lit(None).cast("string")
    return F.coalesce(known, F.when(contents.isNull(), "The note has no contents"), F.when(_odd_front(), "The frontmatter is no list of keys and values"))


@once
def _odd_front() -> Column:
    """Whether a note's frontmatter holds something, and neither a map nor a list that the fold over its lines can read."""
    front = F.regexp_extract("contents", r"\A---\r?\n((?s:.*?))\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)", 1)
    unread = front.rlike(r"(?m)^\s*[^\s#]") & ~front.rlike(r"\A(?:[ \t]*(?:#.*)?\r?\n)*- ") & yaml.block_json(F.split(front, r"\r?\n")).isNull()
    return F.when(F.col("contents").startswith("---"), unread)


def failures(notes: DataFrame) -> DataFrame:
    """(path, error) of the notes that can't be read: no contents, no UTF-8, or frontmatter that isn't YAML (open quotes or
    brackets, keys under a scalar, repeated keys, columns that nothing opened, tabs) or holds text alone."""
    return notes.select("path", _error(notes).alias("error")).where("error is not null")


def readable(notes: DataFrame) -> DataFrame:
    """The notes that can be read; a bad one leaves the others as they are."""
    return notes.where(_error(notes).isNull())


def note_at(notes: DataFrame, path: str) -> DataFrame:
    """(path, contents, error) of one note; no row where there is none."""
    return notes.where(F.col("path") == path).select("path", "contents", _error(notes).alias("error"))
