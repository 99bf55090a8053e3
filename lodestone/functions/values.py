"""Values of schemaless records as typed columns: coercions and the comparison order in which null is greatest.

A Term is a column with its Spark type, so the rules of dynamic typing are settled while the plan is built and
the plan itself holds built-in expressions only.  Comparisons with a literal stay plain enough to be pushed to scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let


@dataclass(frozen=True)
class Term:
    column: Column
    dtype: T.DataType
    #: The name of a bare field, which stands in for its value where a function's argument is null.
    name: str | None = None

    @property
    def kind(self) -> str:
        if isinstance(self.dtype, T.NumericType):
            return "number"
        if isinstance(self.dtype, T.BooleanType):
            return "boolean"
        if isinstance(self.dtype, T.ArrayType):
            return "array"
        if isinstance(self.dtype, (T.StructType, T.MapType)):
            return "object"
        if isinstance(self.dtype, T.VariantType):
            return "variant"
        return "null" if isinstance(self.dtype, T.NullType) else "string"


def literal(value: str | int | float | bool | None) -> Term:
    if value is None:
        return Term(F.lit(None), T.NullType())
    kind = T.BooleanType() if isinstance(value, bool) else T.StringType() if isinstance(value, str) else T.DoubleType()
    return Term(F.lit(float(value)) if isinstance(kind, T.DoubleType) else F.lit(value), kind)


def field(df: DataFrame, name: str) -> Term:
    """A field by its exact name, else by descent through structs from its first part, else from a map column called values, of lists of variants, or fields; an unknown field is null."""
    fields = {f.name: f for f in df.schema.fields}
    if name in fields:
        return Term(df[f"`{name}`"], fields[name].dataType, name)
    head, *rest = name.split(".")
    if not rest or head not in fields:
        for column in ("values", "fields"):
            kind = fields[column].dataType if column in fields else None
            if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and (column == "fields" or kind.valueType == T.ArrayType(T.VariantType())):
                found = F.try_element_at(df[column], F.lit(name))
                if rest and column == "values" and "'" not in name:
                    # A name with points may also be the way into a map of the first part.
                    path = "$" + "".join(f"['{r}']" for r in rest)
                    deep = F.try_variant_get(F.get(F.try_element_at(df[column], F.lit(head)), F.lit(0)), path, "variant")
                    found = F.coalesce(found, F.when(deep.isNotNull(), F.array(deep)))
                return Term(found, kind.valueType, name)
        return Term(F.lit(None), T.NullType(), name)
    column, dtype = df[f"`{head}`"], fields[head].dataType
    for part in rest:
        if isinstance(dtype, T.StructType) and part in dtype.names:
            column, dtype = column[part], dtype[part].dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            column, dtype = column[part], dtype.valueType
        else:
            return Term(F.lit(None), T.NullType(), name)
    return Term(column, dtype, name)


def inside(term: Term, *path: str | int) -> Term:
    """What a variant holds at a path of keys and places; null where it holds nothing there."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return Term(F.try_variant_get(head(term).column, "$" + steps, "variant"), T.VariantType(), term.name)


def head(term: Term) -> Term:
    """Arrays stand for their first element, recursively; objects for null."""
    while term.kind == "array":
        term = Term(F.get(term.column, F.lit(0)), term.dtype.elementType, term.name)
    return Term(F.lit(None), T.NullType(), term.name) if term.kind == "object" else term


#: How deep first elements of lists in variants are looked for.
NESTED = 3


def variant_head(v: Column) -> Column:
    """Lists in a variant stand for their first element, as deep as NESTED."""
    for _ in range(NESTED):
        v = let(v, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$[0]", "variant")).otherwise(x))
    return v


def _variant_number(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _variant_text(v: Column) -> Column:
    plain = ~F.schema_of_variant(v).rlike("^(?:OBJECT|ARRAY|VOID)")
    return F.coalesce(let(_variant_number(v), lambda x: F.when(x.isNotNull(), number_text(x))), F.when(plain, F.try_variant_get(v, "$", "string")))


def number_of(term: Term) -> Column:
    """The number that a term holds; null where it holds something else."""
    term = head(term)
    if term.kind == "number":
        return term.column.cast("double")
    return let(variant_head(term.column), _variant_number) if term.kind == "variant" else F.lit(None).cast("double")


def number_text(x: Column) -> Column:
    """A double's shortest decimal text: integral values without a point, others as plain decimals from 1e-6 to 1e21."""
    whole = (x == F.floor(x)) & (F.abs(x) < 2.0**53)
    plain = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
    digits = F.regexp_replace(F.format_string("%.17f", x), r"0+$", "")
    short = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(whole, x.cast("bigint").cast("string")).when(plain, x.cast("string")).otherwise(F.coalesce(short, digits))


def text(term: Term) -> Column:
    term = head(term)
    if term.kind == "null":
        return F.lit(None).cast("string")
    if term.kind == "number":
        if isinstance(term.dtype, T.IntegralType):
            return term.column.cast("string")
        return number_text(term.column.cast("double"))
    if term.kind == "variant":
        return let(variant_head(term.column), _variant_text)
    if isinstance(term.dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(term.column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return term.column.cast("string")


def shown(term: Term) -> Column:
    """A term as a cell: variants as their texts, other values as they are."""
    if term.kind == "variant":
        return text(term)
    if isinstance(term.dtype, T.ArrayType) and isinstance(term.dtype.elementType, T.VariantType):
        return F.transform(term.column, lambda x: text(Term(x, term.dtype.elementType)))
    return term.column


def _operands(left: Term, right: Term) -> tuple[Column, Column]:
    """Numbers compare as numbers only with numbers; everything else as text."""
    a, b = head(left), head(right)
    if a.kind == "number" and b.kind == "number":
        return a.column, b.column
    return text(a), text(b)


def _is_null(column: Column, term: Term) -> Column:
    return F.lit(True) if head(term).kind == "null" else column.isNull()


def _typed_by_row(compare):
    """Where a side's type is known only row by row, two numbers compare as numbers and all else as text."""

    def compared(left: Term, right: Term) -> Column:
        if "variant" not in (head(left).kind, head(right).kind):
            return compare(left, right)
        # Both sides are worked out once a row.
        both = F.struct(number_of(left).alias("a"), number_of(right).alias("b"), text(left).alias("c"), text(right).alias("d"))

        def of(x):
            number, words = ([Term(x[k], kind, t.name) for k, t in zip(keys, (left, right))] for keys, kind in (("ab", T.DoubleType()), ("cd", T.StringType())))
            return F.when(x["a"].isNotNull() & x["b"].isNotNull(), compare(*number)).otherwise(compare(*words))

        return let(both, of)

    compared.__doc__ = compare.__doc__
    return compared


@_typed_by_row
def eq(left: Term, right: Term) -> Column:
    a, b = _operands(left, right)
    return a.eqNullSafe(b)


def ne(left: Term, right: Term) -> Column:
    return ~eq(left, right)


@_typed_by_row
def lt(left: Term, right: Term) -> Column:
    a, b = _operands(left, right)
    return F.coalesce(a.isNotNull() & (b.isNull() | (a < b)), F.lit(False))


@_typed_by_row
def le(left: Term, right: Term) -> Column:
    a, b = _operands(left, right)
    return F.coalesce(b.isNull() | (a.isNotNull() & (a <= b)), F.lit(False))


@_typed_by_row
def gt(left: Term, right: Term) -> Column:
    a, b = _operands(left, right)
    return F.coalesce(b.isNotNull() & (a.isNull() | (a > b)), F.lit(False))


@_typed_by_row
def ge(left: Term, right: Term) -> Column:
    """Null is greatest, so a null field passes; against a literal this is what a scan can evaluate."""
    a, b = _operands(left, right)
    return a.isNull() | (b.isNotNull() & (a >= b)) if right.name is not None else a.isNull() | (a >= b)


COMPARE = {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}


def truthy(term: Term) -> Column:
    """False for null, false, '', 0 and empty arrays; true otherwise, objects included."""
    c = term.column
    rule = {"boolean": lambda: c, "number": lambda: c != 0, "string": lambda: c != "", "array": lambda: F.size(c) > 0, "object": lambda: c.isNotNull(), "null": lambda: F.lit(False),
            "variant": lambda: ~F.coalesce(number_of(term) == 0, F.lit(False)) & ~F.to_json(c).isin("null", "false", '""', "[]")}
    return F.coalesce(rule[term.kind](), F.lit(False))


def argument(term: Term) -> Column:
    """A function's argument as text; a bare field that is null is replaced by its name."""
    return F.coalesce(text(term), F.lit(term.name)) if term.name is not None else text(term)


def contains(haystack: Term, needle: Term) -> Column:
    """Arrays (nested ones too) hold an element whose text equals the needle's; other values hold it as a part of their text."""
    wanted = F.coalesce(argument(needle), F.lit(""))
    if haystack.kind == "object":
        return F.lit(False)
    if haystack.kind != "array":
        return F.contains(F.coalesce(argument(haystack), F.lit("")), wanted)
    column, dtype = haystack.column, haystack.dtype
    while isinstance(dtype.elementType, T.ArrayType):
        column, dtype = F.flatten(column), dtype.elementType
    held = F.exists(column, lambda x: F.coalesce(text(Term(x, dtype.elementType)), F.lit("")) == wanted)
    return F.coalesce(held, F.lit(False))


def date_text(term: Term, today: str) -> Column:
    """'today' is the given day; any other text is itself, unchecked."""
    value = argument(term)
    return F.when(value == "today", F.lit(today)).otherwise(value)


#: Functions by name, which further ones can join; each takes today's date and its arguments.
FUNCTIONS: dict[str, Callable[..., Term]] = {
    "contains": lambda today, haystack, needle: Term(contains(haystack, needle), T.BooleanType()),
    "date": lambda today, value: Term(date_text(value, today), T.StringType()),
}


def call(name: str, *arguments: Term, today: str, functions: dict[str, Callable[..., Term]] = FUNCTIONS) -> Term:
    """A function's value; a name that no function has gives null, whatever its arguments."""
    found = functions.get(name)
    return literal(None) if found is None else found(today, *arguments)
