"""Metadata search: typed conditions, combined from left to right into one Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as K
from .parse import NUMBER

ORDER = {"=", "!=", ">", "<", ">=", "<="}
TEXT = {"=", "!=", "contains", "starts_with", "ends_with"}


@dataclass(frozen=True)
class Condition:
    """kind: numeric, date, text or auto. combiner: how it joins what stands before it."""

    field: str
    operator: str
    value: str
    kind: str = "auto"
    case_sensitive: bool = False
    combiner: str = "AND"

    @property
    def resolved(self) -> str:
        if self.kind != "auto":
            return self.kind
        return "numeric" if self.operator in {">", "<", ">=", "<="} else "text"


def validate(conditions: list[Condition], columns: list[str]) -> list[str]:
    """What is wrong with conditions, in words; empty if nothing is."""
    errors = []
    for i, c in enumerate(conditions, 1):
        allowed = TEXT if c.resolved == "text" else ORDER
        if c.field not in columns:
            errors.append(f"{i}: no field {c.field}")
        if c.operator not in allowed:
            errors.append(f"{i}: {c.operator} is not for {c.resolved}")
        if c.resolved == "numeric":
            try:
                float(c.value)
            except ValueError:
                errors.append(f"{i}: {c.value!r} is no number")
        elif c.value.strip() == "":
            errors.append(f"{i}: no value")
        if c.combiner not in ("AND", "OR"):
            errors.append(f"{i}: unknown combiner {c.combiner}")
    return errors


def compare(left: Column, operator: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[operator]


def predicate(c: Condition) -> Column:
    """True, false or null (blank or not a number where one is needed)."""
    text = F.trim(F.col(c.field).cast("string"))
    filled = F.when(text != "", text)
    if c.resolved == "numeric":
        return compare(F.when(text.rlike(NUMBER), text.try_cast("double")), c.operator, F.lit(float(c.value)))
    if c.resolved == "date":  # ISO text sorts as dates do
        return compare(filled, c.operator, F.lit(c.value.strip()))
    value = c.value.strip()
    if not c.case_sensitive:
        filled, value = F.lower(filled), value.lower()
    if c.operator in ("=", "!="):
        return compare(filled, c.operator, F.lit(value))
    return {"contains": filled.contains, "starts_with": filled.startswith, "ends_with": filled.endswith}[c.operator](value)


def combine(conditions: list[Condition]) -> Column:
    """Strictly from the left; without conditions nothing matches."""
    if not conditions:
        return F.lit(False)
    out = F.coalesce(predicate(conditions[0]), F.lit(False))
    for c in conditions[1:]:
        p = F.coalesce(predicate(c), F.lit(False))
        out = out | p if c.combiner == "OR" else out & p
    return out


def search(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    if errors := validate(conditions, df.columns):
        raise ValueError("; ".join(errors))
    return df.where(combine(conditions))


def contains_any(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns holds the text, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle.lower())
    return df.where(hit)


def simple_filter(df: DataFrame, fields: dict) -> DataFrame:
    """{field: value} or {field: {'operator', 'value'}}, all of them."""
    for name, spec in fields.items():
        op, value = (spec["operator"], spec["value"]) if isinstance(spec, dict) else ("=", spec)
        df = df.where(compare(F.col(name), op, F.lit(value)))
    return df


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Trimmed values that aren't blank, in order without case, and whether more were left out."""
    v = F.trim(F.col(column).cast("string"))
    some = df.select(v.alias("value")).where("value <> ''").distinct().orderBy(F.lower("value"), "value").limit(limit + 1)
    many = some.agg((F.count("*") > limit).alias("truncated"))
    return some.orderBy(F.lower("value"), "value").limit(limit).crossJoin(F.broadcast(many))  # one row


def tree_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All rows with their place (from 1) in the tree: per position the null token first, then names without case.

    Rows are ranked among those with one first block; an aggregate by first block says how many stand before them."""
    keys = [k for c in columns for k in (F.col(c) != K.NULL, F.lower(c))]
    named = rows.withColumns({"filled": keys[0], "low": keys[1]})
    sizes = named.groupBy("filled", "low").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("filled", "low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = named.withColumn("own", F.row_number().over(W.partitionBy("filled", "low").orderBy(*keys[2:])))
    placed = ranked.join(sizes.select("filled", "low", before.alias("before")), ["filled", "low"])
    return placed.select(*rows.columns, (F.col("before") + F.col("own")).alias("place"))


def missing_extra(found: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Names, without case, that are found and not known (missing), or known and not found (extra)."""
    a, b = (df.select(F.lower(column).alias("name")).distinct() for df in (found, known))
    missing, extra = a.join(b, "name", "left_anti"), b.join(a, "name", "left_anti")
    return missing.withColumn("side", F.lit("missing")).union(extra.withColumn("side", F.lit("extra")))
