"""Query and update operators over document tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import ROWS, numbered

_OPS = {"=": "eq", "<>": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le", "IN": "in", "NOT IN": "nin", "regex": "re"}


def _compare(field: str, op: str, value) -> Column:
    c = F.col(field)
    if op in ("=", "<>"):
        found = c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False))
        return found if op == "=" else ~found
    if op in ("IN", "NOT IN"):
        values = list(value)
        found = F.coalesce(
            c.isin([v for v in values if v is not None]), F.lit(False)
        ) if any(v is not None for v in values) else F.lit(False)
        found = found | c.isNull() if None in values else found
        return found if op == "IN" else ~found
    if op == "regex":
        return F.coalesce(F.regexp_like(c, F.lit(value)), F.lit(False))
    return F.coalesce({">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op], F.lit(False))


def where(spec) -> Column:
    """Predicate of a condition tree; missing fields are NULL, and `<>` and `NOT IN` keep them.

    (field, op, value) is a condition; a list means all of its members; a mapping holds field: value (a list value
    means IN) and the keys `and` and `or` with lists of trees, all of them required.
    """
    if spec is None or spec == [] or spec == {}:
        return F.lit(True)
    if isinstance(spec, tuple):
        field, op, value = spec
        op = op if op in _OPS else op.upper()
        if op not in _OPS:
            raise ValueError(f"unknown operator {op!r}")
        return _compare(field, op, value)
    if isinstance(spec, Mapping):
        out = F.lit(True)
        for key, value in spec.items():
            if key == "and":
                out = out & where(list(value))
            elif key == "or":
                any_of = F.lit(False)
                for part in value:
                    any_of = any_of | where(part)
                out = out & any_of
            else:
                out = out & _compare(key, "IN" if isinstance(value, (list, set, frozenset)) else "=", value)
        return out
    out = F.lit(True)
    for part in spec:
        out = out & where(part)
    return out


def _order(sort: Sequence[tuple[str, int]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if d >= 0 else F.col(c).desc_nulls_last() for c, d in sort]


def find(
    df: DataFrame, spec=None, select: Sequence[str] | None = None, sort: Sequence[tuple[str, int]] = (), offset: int = 0,
    hits: int | None = 10
) -> DataFrame:
    """Filter, project, sort, skip and limit; ten rows by default, all with hits=None."""
    out = df.where(where(spec))
    out = out.orderBy(*_order(sort)) if sort else out
    out = out.offset(offset) if offset else out
    out = out.limit(hits) if hits is not None else out
    return out.select(*select) if select else out


def get(df: DataFrame, spec=None, select: Sequence[str] | None = None, sort: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """First match, as a DataFrame of at most one row."""
    return find(df, spec, select, sort, hits=1)


def count(df: DataFrame, spec=None) -> DataFrame:
    return df.where(where(spec)).agg(F.count("*").alias("n"))


def update(df: DataFrame, values: Mapping[str, Column | object], spec, *, now: int, multi: bool = True, key: str = "uuid") -> DataFrame:
    """Set values (and utime) where the condition holds; with multi=False in the row of the least key only.  An empty condition changes nothing."""
    if not spec:
        return df
    hit = where(spec)
    if not multi:
        first = df.where(hit).agg(F.min(key).alias("_first"))
        df = df.join(F.broadcast(first), F.lit(True), "left")  # one row
        hit = hit & F.coalesce(F.col(key) == F.col("_first"), F.lit(False))
    values = {**values, "utime": now}
    out = df.withColumns(
        {
            c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c,
            v in values.items()
        }
    )
    return out.drop("_first")


def soft_delete(df: DataFrame, spec, *, now: int) -> DataFrame:
    return update(df, {"status": -1}, spec, now=now)


def hard_delete(df: DataFrame, spec) -> DataFrame:
    return df.where(~where(spec)) if spec else df


def page_after(df: DataFrame, last, n: int, spec=None, key: str = "uuid") -> DataFrame:
    """Keyset paging: the next n rows by key after `last`."""
    return df.where((F.col(key) > last) & where(spec)).orderBy(key).limit(n)


def max_id(df: DataFrame, column: str = "uuid", spec=None) -> DataFrame:
    return df.where(where(spec)).agg(F.max(column).alias("max_id"))


def assign_ids(df: DataFrame, order: Sequence[str], start: int = 0, column: str = "uuid", rows: int = ROWS) -> DataFrame:
    """Increasing ids start+1, start+2, ... in the order of columns that tell rows apart, of any orderable type; NULLs come first.

    Rows are numbered in ranges of the order, about `rows` to a range, whose counts give offsets.
    """
    return numbered(df, order, rows).withColumn(column, (F.col("_at") + start + 1).cast("long")).drop("_at")


def build_month_id(ctime: Column, id_: Column) -> Column:
    """base64 of YYYYMM and the id."""
    return F.base64(F.encode(F.concat(F.date_format(F.timestamp_seconds(ctime), "yyyyMM"), id_.cast("string")), "utf-8"))


def split_month_id(rid: Column) -> Column:
    """struct(ym, id) of build_month_id."""
    text = F.decode(F.unbase64(rid), "utf-8")
    return F.struct(F.substring(text, 1, 6).alias("ym"), F.substring(text, F.lit(7), F.length(text)).alias("id"))


def with_defaults(df: DataFrame, *, now: int) -> DataFrame:
    """Missing fields of new task rows: status 0, ctime now, utime, plantime, crawltime and expire 0."""
    defaults = {"status": 0, "ctime": now, "utime": 0, "plantime": 0, "crawltime": 0, "expire": 0}
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v).cast("int" if c == "status" else "long") for c,
            v in defaults.items()
        }
    )
