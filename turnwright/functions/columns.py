"""Small helpers of column expressions: values written once, and tables of constants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written once, so that expressions built on expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_text(value: Column, body: Callable[[Column], Column]) -> Column:
    """let() of a body that is a string. Its type is named, so analysis need not find it from all lambdas below, each of which doubles that work."""
    return let(value, body).cast("string")


def lookup(values: dict[str, object], key: Column) -> Column:
    """The key's value as a string, or null."""
    return F.try_element_at(F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in values.items())), F.lit("\n"), F.lit("\t")), key)
