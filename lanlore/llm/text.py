"""Expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the word rules: white space between plain words, and everything that is no part of a bare word.
SPACE = r"[\x20\x09-\x0D]+"
NOT_BARE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def split_words(text: Column | str, between: str = SPACE) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(as_column(text), F.lit("")), between), "")


def lower_ascii(text: Column | str) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII texts take the fast way."""
    text = as_column(text)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stripped_of(text: Column, characters: str) -> Column:
    """How many characters of a class (a regular expression) a text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns an operator is about to add; an operator's own columns replace equal names."""
    wanted = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted])


def where_settled(df: DataFrame, condition: Column) -> DataFrame:
    """`df` filtered after its columns were computed.

    Spark pushes a filter below the projections that its columns come from, and writes their expressions out anew in it,
    inside lambdas once per element. Where those are costly, a column that must not move holds the filter in its place.
    """
    return df.withColumn("_settled", F.monotonically_increasing_id()).where(condition & (F.col("_settled") >= 0)).drop("_settled")
