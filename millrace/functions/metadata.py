"""Merging metadata maps: which side wins where both have a key, and the small operations on one map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(left: Column, right: Column, policy: str = "raise") -> Column:
    """One map of both: ``update`` lets the right side win, ``reject`` the left, ``raise`` fails on a key that both have. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    if policy == "update":
        return F.map_zip_with(left, right, lambda k, x, y: F.coalesce(y, x))
    if policy == "reject":
        return F.map_zip_with(left, right, lambda k, x, y: F.coalesce(x, y))
    if policy == "raise":
        both = F.array_intersect(F.map_keys(left), F.map_keys(right))
        return F.when(F.size(both) == 0, F.map_concat(left, right)).otherwise(F.raise_error(F.concat(F.lit("metadata key on both sides: "), F.array_join(both, ", "))))
    raise ValueError(f"unknown policy {policy!r}")


def merge_ports(ports: list[Column], policy: str = "raise") -> Column:
    """The maps of several input ports, merged in the order in which they are received."""
    return reduce(lambda a, b: merge(a, b, policy), ports)


def put(meta: Column, key: str, value: Column) -> Column:
    return merge(meta, F.create_map(F.lit(key), value.cast("string")), "update")


def get(meta: Column, key: str, default: Column | None = None) -> Column:
    got = F.try_element_at(meta, F.lit(key))
    return got if default is None else F.coalesce(got, default)


def erase(meta: Column, *keys: str) -> Column:
    return F.map_filter(meta, lambda k, v: ~k.isin(*keys))


def has_key(meta: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(meta, F.lit(key)), F.lit(False))


def cleared(meta: Column) -> Column:
    """An empty map where there is one."""
    return F.map_filter(meta, lambda k, v: F.lit(False))


def inserted(meta: Column, other: Column) -> Column:
    """The keys of ``other`` that ``meta`` lacks are added; those it has stay as they are."""
    return merge(meta, other, "reject")


def swapped(a: Column, b: Column) -> tuple[Column, Column]:
    """Each in the other's place."""
    return b, a


def emitted(meta: Column) -> Column:
    """What goes out with a message: nothing if the map is empty."""
    return F.when(F.size(meta) > 0, meta)
