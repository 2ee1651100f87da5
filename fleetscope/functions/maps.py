"""String maps, where NULL and empty mean the same."""

from pyspark.sql import Column, functions as F


def entries(m: Column) -> Column:
    """Sorted entries: a comparable form of the map."""
    return F.coalesce(F.array_sort(F.map_entries(m)), F.array().cast("array<struct<key:string,value:string>>"))


def differ(left: Column, right: Column) -> Column:
    return entries(left) != entries(right)


def to_text(m: Column) -> Column:
    return F.array_join(F.transform(entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def changed(prev: Column, curr: Column) -> Column:
    """Entries of ``curr`` that are new or have another value; removed keys are not reported."""
    prev = F.coalesce(prev, F.create_map().cast("map<string,string>"))
    return F.map_filter(
        F.coalesce(curr, F.create_map().cast("map<string,string>")),
        lambda k, v: ~F.try_element_at(prev, k).eqNullSafe(v),
    )


def merged(prev: Column, curr: Column) -> Column:
    """``prev`` overlaid with ``curr``; an empty ``curr`` stays empty."""
    empty = F.create_map().cast("map<string,string>")
    prev, curr = F.coalesce(prev, empty), F.coalesce(curr, empty)
    return F.when(F.size(curr) == 0, empty).otherwise(
        F.map_zip_with(prev, curr, lambda _k, old, new: F.coalesce(new, old))
    )
