"""Array, map and JSON expressions of the document library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_tags(old: Column, new: Column) -> Column:
    """The sorted union of two tag lists; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none)))


def first_touch(old: Column, new: Column) -> Column:
    """The union of two metadata maps in which keys that are there already keep their values."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)))


def metadata_matches(metadata: Column, key: str, expected: str) -> Column:
    """Whether a value equals the expected one without regard to case; a missing one equals only '', 'null' and 'none'. A JSON list matches by any item."""
    want = expected.lower()
    value = F.element_at(metadata, F.lit(key))
    items = F.from_json(value, "array<string>")
    listed = F.coalesce(F.exists(items, lambda v: F.lower(v) == want), F.lit(False)) & F.startswith(value, F.lit("["))
    return F.when(value.isNull(), F.lit(want in {"", "null", "none"})).otherwise((F.lower(value) == want) | listed)


def median(values: Column, default: float = 0.0) -> Column:
    """The middle of an array, the mean of the middle two where it is even, the default where it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2).otherwise(F.lit(default))


def python_json(pairs: dict[str, Column | None]) -> Column:
    """An object's JSON with sorted keys, a blank after each colon and comma, and no escapes beyond quotes, backslashes and control characters: what ids are hashed from."""
    parts = []
    for name in sorted(pairs):
        value = pairs[name]
        text = F.lit("null") if value is None else value
        parts.append(F.concat(F.lit(f'"{name}": '), text))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_string(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: within functions over arrays an expression is evaluated again wherever it stands."""
    return F.transform(F.array(value), then)[0]
