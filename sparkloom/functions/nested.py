"""JSON, lists, structs and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_extract(x: Column, path: str) -> Column:
    """JSON text: strings keep their quotes."""
    raw = F.get_json_object(x, path)
    quoted = F.to_json(F.struct(raw.alias("v")))
    as_text = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    plain = raw.rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[{].*[\]}])$")
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(plain, raw).otherwise(as_text)


def json_array_length(x: Column) -> Column:
    return F.coalesce(F.json_array_length(x), F.lit(0)).cast("bigint")


def json_valid(x: Column) -> Column:
    """One value and nothing after it: inside brackets it must be a list of one."""
    inside = F.concat(F.lit("["), x, F.lit("]"))
    one = F.coalesce(F.json_array_length(inside), F.lit(0)) == 1
    return F.when(x.isNotNull(), F.try_parse_json(inside).isNotNull() & one)


def json_keys(x: Column) -> Column:
    return F.json_object_keys(x)


def collect_with_nulls(x: Column, *order: Column) -> Column:
    """A list that keeps NULLs, in the given order."""
    if not order:
        return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, x.alias("v")))), lambda s: s["v"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, v: t + v))


def list_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + F.coalesce(v.cast("double"), F.lit(0.0)))


def list_slice(a: Column, first: int, last: int) -> Column:
    """Both ends included, from 1."""
    return F.slice(a, first, max(0, last - first + 1))


def json_exists(x: Column, path: str) -> Column:
    """A member that is null exists, and so does its path."""
    return F.when(x.isNotNull(), F.try_variant_get(F.try_parse_json(x), path, "variant").isNotNull())


def json_group_array(x: Column, *order: Column) -> Column:
    """JSON text of a group's values; NULLs are null."""
    return F.to_json(collect_with_nulls(x, *order), {"ignoreNullFields": "false"})


def json_group_object(k: Column, v: Column) -> Column:
    """JSON text of a group's pairs by key; keys must not repeat."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k.cast("string").alias("k"), v.alias("v"))))))


def map_extract(m: Column, k: Column) -> Column:
    """A list of the key's value, empty without the key."""
    return F.when(F.map_contains_key(m, k), F.array(F.try_element_at(m, k))).when(m.isNotNull(), F.array().cast("array<string>"))


def subscripts(a: Column) -> Column:
    """Places of a list, from 1; none of an empty one."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
