"""Queries over records: list, table and task views as chained calls on a DataFrame.

The steps run in a fixed order whatever the order of calls: source, conditions, sort, limit, projection, group metadata.
Conditions and sort keys are Terms and columns from functions.values, so the plan is Catalyst's to optimise.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.frames import numbered


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    #: Labels of the columns of rows, in order; labels may repeat, the names of columns can't.
    labels: tuple[str, ...]
    groups: DataFrame | None = None
    #: The query as it was named, and its source: a path as it is, null for a tag, for several whether they hold of an empty record.
    metadata: dict[str, str | bool | None] = field(default_factory=dict)


def from_path(path: Column, source: str) -> Column:
    """A path in a composed source: '.', the path itself, the same with '.md', or a folder."""
    return F.lit(True) if source == "." else (path == source) | (path == f"{source}.md") | path.startswith(f"{source}/")


def from_tag(df: DataFrame, tag: str) -> Column:
    """Membership in any of the tag fields that the records have, exact and case-sensitive."""
    found = F.lit(False)
    for name in ("file.tags", "file.etags", "tags"):
        term = V.field(df, name)
        if term.kind == "array" and V.Term(term.column, term.dtype.elementType).kind == "variant":
            found = found | F.coalesce(F.exists(term.column, lambda x: V.text(V.Term(x, term.dtype.elementType)) == tag), F.lit(False))
        elif term.kind == "array":
            found = found | F.coalesce(F.array_contains(term.column, tag), F.lit(False))
        elif term.kind == "string":
            found = found | F.coalesce(term.column == tag, F.lit(False))
    return found


@dataclass(frozen=True)
class NoteQuery:
    df: DataFrame
    #: Columns that settle ties, so results don't depend on partitions.
    order: tuple[str, ...]
    conditions: tuple[Column, ...] = ()
    keys: tuple[Column, ...] = ()
    most: int | None = None
    shown: tuple[tuple[str, V.Term], ...] = field(default=())
    group: V.Term | None = None
    metadata: tuple[tuple[str, str | bool | None], ...] = ()

    def named(self, query: str) -> NoteQuery:
        """The query with a text that stands for it in the metadata of its result."""
        return replace(self, metadata=(*self.metadata, ("query", query)))

    def source(self, *sources: str, every: bool = False) -> NoteQuery:
        """Records of a path or a #tag; of several sources, of any of them or of every one."""
        path = V.field(self.df, "file.path" if "file.path" in self.df.columns else "path").column
        tests = [from_tag(self.df, s) if s.startswith("#") else from_path(path, s) for s in sources]
        held = [bool(s) and not s.startswith("#") for s in sources]
        known = (all(held) if every else any(held)) if len(sources) > 1 else sources[0] if held[0] else None
        return replace(self.where(reduce(and_ if every else or_, tests)), metadata=(*self.metadata, ("source", known)))

    def term(self, name: str) -> V.Term:
        return V.field(self.df, name)

    def where(self, *conditions: Column | V.Term) -> NoteQuery:
        return replace(self, conditions=(*self.conditions, *(V.truthy(c) if isinstance(c, V.Term) else c for c in conditions)))

    def compare(self, name: str, op: str, other) -> NoteQuery:
        right = other if isinstance(other, V.Term) else V.literal(other)
        return self.where(V.COMPARE[op](self.term(name), right))

    def sort(self, *names: str) -> NoteQuery:
        """Ascending with nulls last; a leading '-' gives the exact reverse, nulls first."""
        made = []
        for n in names:
            term = V.head(self.term(n.removeprefix("-")))
            keys = [term.column] if term.kind in ("number", "null") else [V.text(term)]
            if term.kind == "variant":  # numbers by size before texts, nulls after both
                keys = [F.when(V.number_of(term).isNotNull(), 0).when(V.text(term).isNotNull(), 1), V.number_of(term), V.text(term)]
            made += [key.desc_nulls_first() if n.startswith("-") else key.asc_nulls_last() for key in keys]
        return replace(self, keys=(*self.keys, *made))

    def limit(self, n: int) -> NoteQuery:
        if n < 1:
            raise ValueError("a limit is a positive integer")
        return replace(self, most=n)

    def show(self, *names: str, **labelled: V.Term) -> NoteQuery:
        return replace(self, shown=(*self.shown, *((n, self.term(n)) for n in names), *labelled.items()))

    def group_by(self, name: str) -> NoteQuery:
        return replace(self, group=self.term(name))

    def records(self) -> DataFrame:
        """The records that pass, in order."""
        out = self.df
        for c in self.conditions:
            out = out.where(c)
        if self.keys or self.most:
            out = out.orderBy(*self.keys, *self.order)
        return out.limit(self.most) if self.most else out

    def run(self, file_link: str | None = None, fields: bool = True) -> Result:
        """Cells of the shown columns (all fields where none is named, unless `fields` is off), with the file column first where it is asked for."""
        d = self.records()
        shown = [(n, t) for n, t in self.shown] or [(n, V.field(d, n)) for n in d.columns if fields]
        if file_link:
            shown.insert(0, ("File", V.field(d, file_link)))
        names, cells = [], []
        for label, term in shown:
            name = label if label not in names else f"{label}_{len(names)}"
            names.append(name)
            cells.append(V.shown(term).alias(name))
        return Result(d.select(*cells), tuple(n for n, _ in shown), self.groups() if self.group else None, dict(self.metadata))

    def group_rows(self) -> DataFrame:
        """(key, i): the group and the 0-based place, after sort and limit, of every record.  No row grows with a group."""
        key = F.coalesce(V.text(self.group), F.lit(""))
        if self.most:
            number = F.row_number().over(Window.orderBy(*self.keys, *self.order)) - 1
            return self.records().select(key.alias("key"), number.cast("long").alias("i"))
        rows = replace(self, keys=(), most=None).records().withColumn("group_", key)
        return numbered(rows, *self.keys, *self.order).select(F.col("group_").alias("key"), "i")

    def groups(self) -> DataFrame:
        """(key, label, row_indexes) in order of first appearance; row_indexes is one array for each group, for results of moderate size (else group_rows)."""
        per = self.group_rows().groupBy("key").agg(F.sort_array(F.collect_list(F.col("i").cast("int"))).alias("row_indexes"))
        return per.select("key", F.col("key").alias("label"), "row_indexes").orderBy(F.get("row_indexes", F.lit(0)))


def first_seen_keys(records: DataFrame, order: str, pairs: str) -> DataFrame:
    """(key, ord) of all keys in array<struct<key, value>> columns, by first appearance; keys are few."""
    d = records.select(F.col(order).alias("row_"), F.posexplode(pairs).alias("pos_", "p"))
    first = d.groupBy(F.col("p.key").alias("key")).agg(F.min(F.struct("row_", "pos_")).alias("at"))
    return first.select("key", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"))
