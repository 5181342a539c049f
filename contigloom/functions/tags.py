"""Optional fields of a record: ``map<string,struct<type,i,f,s,arr>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_MAP = "map<string,struct<type:string,i:bigint,f:double,s:string,arr:array<double>>>"
# Type letters read as signed 32-bit, and those only unsigned.
SIGNED_INTEGER = ("A", "c", "s", "i")
UNSIGNED_INTEGER = ("C", "S", "I")


def int_tag(tags: Column, key: str, signed_only: bool = False) -> Column:
    """Integer value of a tag, NULL when absent or of another type.

    ``signed_only`` also ignores unsigned storage types.
    """
    kinds = SIGNED_INTEGER if signed_only else SIGNED_INTEGER + UNSIGNED_INTEGER
    return F.when(tags[key]["type"].isin(*kinds), tags[key]["i"])


def has_tag(tags: Column, key: str) -> Column:
    return F.map_contains_key(tags, key)


def tag_names(tags: Column) -> Column:
    return F.array_sort(F.map_keys(tags))


def tag_type(tags: Column, key: str) -> Column:
    return tags[key]["type"]


def remove_tag(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != key)


def set_tag(tags: Column, key: str, value: Column) -> Column:
    """Add, or replace whatever the tag held."""
    return F.map_concat(remove_tag(tags, key), F.create_map(F.lit(key), value))


def add_tag(tags: Column, key: str, value: Column) -> Column:
    """Add; an existing tag stays as it is."""
    return F.when(has_tag(tags, key), tags).otherwise(
        F.map_concat(tags, F.create_map(F.lit(key), value))
    )
