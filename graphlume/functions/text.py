"""Small column functions that queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_name(name: Column) -> Column:
    """A label or type from a catalog's notation: without a leading colon and surrounding backticks."""
    return F.regexp_replace(F.regexp_replace(name, "^:", ""), "^`|`$", "")


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | name.endswith(s)
    return found


def finite(value: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def merge_maps(first: Column, *others: Column) -> Column:
    """Maps in one; the later map's value wins."""
    out = first
    for other in others:
        out = F.map_concat(_without(out, other), other)
    return out


def _without(one: Column, other: Column) -> Column:
    return F.map_filter(one, lambda k, _: ~F.map_contains_key(other, k))
