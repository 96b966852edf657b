"""Column expressions: name resolution, coercion and lookups, all settled at plan time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)


def named(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """PRJ2: the first candidate that is a column of `df`."""
    have = set(df.columns)
    return next((name for name in candidates if name in have), None)


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]], defaults: Mapping[str, object]) -> dict[str, Column]:
    """PRJ2: each wanted column as its first present candidate, else its default literal."""
    out = {}
    for target, candidates in wanted.items():
        found = first_present(df, candidates)
        if found is not None:
            out[target] = named(found)
        elif target in defaults:
            default = defaults[target]
            out[target] = default if isinstance(default, Column) else F.lit(default)
        else:
            raise ValueError(f"no column for {target}: tried {list(candidates)}, have {df.columns}")
    return out


def add_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """PRJ1: copy raw columns to canonical names where those are absent; raw columns stay."""
    have = set(df.columns)
    new = {dst: named(src) for src, dst in aliases.items() if src in have and dst not in have}
    return df.withColumns(new) if new else df


def to_number(value: Column, default: float = 0.0) -> Column:
    """PRJ5: numeric coercion; what does not parse, nulls and NaN become `default`."""
    number = value.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(default))


def to_whole(value: Column) -> Column:
    """PRJ5 for counters: coerced, then truncated to a bigint."""
    return F.coalesce(to_number(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def from_unix_seconds(value: Column) -> Column:
    return F.timestamp_micros(F.round(value * F.lit(1e6)).try_cast("bigint"))


def to_instant(df: DataFrame, name: str) -> Column:
    """PRJ4: a timestamp from a column that is a timestamp, Unix seconds or text."""
    kind = df.schema[name].dataType
    value = named(name)
    if isinstance(kind, T.TimestampType):
        return value
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(kind, NUMERIC):
        return from_unix_seconds(F.nanvl(value.cast("double"), F.lit(None).cast("double")))
    return F.try_to_timestamp(value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares as the largest value in Spark; drop it to null before any rule looks at it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    null = F.lit(None)
    return df.withColumns({c: F.nanvl(named(c), null.cast(df.schema[c].dataType)) for c in floats}) if floats else df


def feature_columns(df: DataFrame, metadata: Iterable[str] = ("device_id", "time_window", "label")) -> list[str]:
    """PRJ13: every column that is not metadata."""
    skip = set(metadata)
    return [c for c in df.columns if c not in skip]


def fill_numeric(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """PRJ15: numeric nulls and NaN to 0, other columns untouched."""
    skipped = set(skip)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skipped]
    return nan_to_null(df).na.fill(0, [f"`{c}`" if "." in c else c for c in numeric]) if numeric else df


def lookup(table: Mapping, key: Column, default: Column) -> Column:
    """A small fixed mapping as one map literal."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def truthy(condition: Column) -> Column:
    """A condition where null counts as false."""
    return F.coalesce(condition, F.lit(False))


def or_zero(df: DataFrame, name: str) -> Column:
    """A column, or 0 where the table has none of that name or the value is null."""
    return F.coalesce(named(name), F.lit(0)) if name in df.columns else F.lit(0)
