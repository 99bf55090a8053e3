"""Rows as text: cells, Markdown lines and JSON lines, made by Spark; whole documents only of bounded results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Term, text
from .notequery import Result

#: A document is collected up to this many rows.
MOST_ROWS = 10_000


def cell(column: Column, dtype: T.DataType) -> Column:
    """null is empty, flat arrays are joined by commas, nested values are JSON."""
    if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, (T.ArrayType, T.StructType, T.MapType)):
        inner = F.transform(column, lambda x: F.coalesce(text(Term(x, dtype.elementType)), F.lit("")))
        return F.coalesce(F.array_join(inner, ", "), F.lit(""))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.to_json(column), F.lit(""))
    return F.coalesce(text(Term(column, dtype)), F.lit(""))


def markdown_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(line) of each row as a Markdown table row; columns named in keep stay beside it."""
    safe = [F.regexp_replace(F.regexp_replace(cell(df[f"`{f.name}`"], f.dataType), r"\|", r"\\|"), r"\r?\n", "<br>") for f in df.schema.fields]
    return df.select(*keep, F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |")).alias("line"))


def json_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))


def markdown_table(df: DataFrame) -> str:
    """The table of a bounded result; more rows than MOST_ROWS are refused."""
    if not df.columns:
        return "No rows found."
    lines = [r.line for r in markdown_lines(df).limit(MOST_ROWS + 1).collect()]
    if len(lines) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write markdown_lines() instead")
    return "\n".join([f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |", *lines])


def json_document(result: Result) -> str:
    """A bounded result as one JSON document with columns, rows, groups and metadata; more rows than MOST_ROWS are refused."""
    keys = result.rows.columns
    rows = [json.loads(r.line) for r in json_lines(result.rows.toDF(*[f"c{n}" for n in range(len(keys))])).limit(MOST_ROWS + 1).collect()]
    groups = [] if result.groups is None else result.groups.limit(MOST_ROWS + 1).collect()
    if max(len(rows), len(groups)) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write json_lines() instead")
    document = {
        "_tag": "QueryResult",
        "columns": [{"key": k, "label": label} for k, label in zip(keys, result.labels, strict=True)],
        "rows": [[r[f"c{n}"] for n in range(len(keys))] for r in rows],
        "groups": [{"key": g.key, "label": g.label, "rowIndexes": g.row_indexes} for g in groups],
        "metadata": result.metadata,
    }
    return json.dumps(document, indent=2, ensure_ascii=False)
