"""Building-block names, positions and classes as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.parse import rt_value

#: Fixed value: the token for no building block.
NULL = "AgxNull"


@F.pandas_udf(StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s.strip()))


def normalise(name: Column) -> Column:
    """Trimmed, composed Unicode; plain ASCII doesn't leave the JVM."""
    return F.when(name.rlike(r"^[\x00-\x7f]*$"), F.trim(name)).otherwise(_composed(name))


def canonical_names(names: DataFrame) -> DataFrame:
    """key (lower case), spelling: the least spelling of each name."""
    return names.where("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("spelling"))


def canonical(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Replaces a name by its canonical spelling, where there is one."""
    return df.withColumn("key", F.lower(column)).join(known, "key", "left").withColumn(column, F.coalesce("spelling", column)).drop("key", "spelling")


def class_of(positions: Column, null: str = NULL) -> Column:
    return F.filter(positions, lambda x: x != null)


def tier(positions: Column, null: str = NULL) -> Column:
    return F.size(class_of(positions, null))


def label(positions: Column, null: str = NULL) -> Column:
    return F.array_join(class_of(positions, null), "-")


def parents(class_: Column) -> Column:
    """Distinct classes with one block less."""
    n = F.size(class_)
    drop = lambda i: F.concat(F.slice(class_, F.lit(1), i), F.slice(class_, i + 2, n))
    none = F.array().cast("array<array<string>>")
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), drop))).otherwise(none)


def node_id(positions: Column, n: int, null: str = NULL) -> Column:
    c = class_of(positions, null)
    full = F.concat_ws("_", F.lit(f"F{n}"), F.array_join(positions, "_"))
    return F.when(F.size(c) == n, full).when(F.size(c) == 0, "C0").otherwise(F.concat_ws("_", F.concat(F.lit("C"), F.size(c).cast("string")), F.array_join(c, "_")))


def padded(class_: Column, n: int, null: str = NULL) -> Column:
    """A class placed at the end of n positions."""
    return F.concat(F.array_repeat(F.lit(null), n - F.size(class_)), class_)


def is_cassette(bb: Column) -> Column:
    return F.contains(bb, F.lit("-"))


def components(bb: Column) -> Column:
    return F.split(bb, "-")


def null_masks(positions: Column, n: int, null: str = NULL) -> Column:
    """All strict truncations: each non-empty set of positions turned to null."""
    bit = lambda mask, i: F.getbit(mask, i) == 1
    one = lambda mask: F.transform(positions, lambda x, i: F.when(bit(mask, i), null).otherwise(x))
    return F.transform(F.sequence(F.lit(1), F.lit(2**n - 1)), one)


def is_truncation(positions: Column, of: Column, null: str = NULL) -> Column:
    """Each position is null or as in the other, and they differ."""
    return F.forall(F.zip_with(positions, of, lambda a, b: (a == null) | (a == b)), lambda x: x) & (positions != of)


def is_full(positions: Column, n: int, null: str = NULL) -> Column:
    return (F.size(positions) == n) & ~F.array_contains(positions, null)


def only_blocks(positions: Column, blocks: list[str], null: str = NULL) -> Column:
    return F.size(F.array_except(positions, F.array(*(F.lit(b) for b in [*blocks, null])))) == 0


def isoforms(df: DataFrame, wanted: list[str] | None, column: str = "variant") -> DataFrame:
    """Rows of the wanted variants; None or 'all' keeps every row."""
    if not wanted or "all" in wanted:
        return df
    return df.where(F.trim(column).isin([w.strip() for w in wanted]))


def cyclised_rt(df: DataFrame) -> Column:
    """The first readable value in columns whose name tells a cyclised retention time."""
    found = [c for c in df.columns if "cyclized" in c.lower() and "rt" in c.lower()]
    return F.coalesce(*(rt_value(F.col(f"`{c}`")) for c in found)) if found else F.lit(None).cast("double")


def gaussian(x: Column, amplitude: float, mean: float, stddev: float) -> Column:
    return amplitude * F.exp(-F.pow((x - mean) / (2 * stddev), 2))


def rt_header(name: str, unit: str) -> str:
    return f"{name} ({'min' if unit == 'minutes' else 's'})"


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def rt_offset(rt: Column, null_rt: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (rt - null_rt) / 10))
