"""Buckets and allow-lists of analytics events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stepped(value: Column, steps: list[tuple[float, str]], last: str, inclusive: bool) -> Column:
    out = F.lit(last)
    for edge, name in reversed(steps):
        out = F.when(value <= edge if inclusive else value < edge, name).otherwise(out)
    return out


def duration_bucket(seconds: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.coalesce(seconds.cast("double"), F.lit(0.0)))
    return _stepped(v, [(30, "under_30s"), (120, "30s_2m"), (300, "2m_5m"), (600, "5m_10m")], "10m_plus", False)


def count_bucket(count: Column) -> Column:
    v = F.greatest(F.lit(0), F.coalesce(count, F.lit(0)))
    return _stepped(v, [(0, "0"), (3, "1_3"), (10, "4_10")], "11_plus", True)


def minute_bucket(minute: Column) -> Column:
    return _stepped(minute, [(1, "1"), (4, "2_4"), (9, "5_9")], "10_plus", True)


def normalized_value(v: Column, limit: int = 48) -> Column:
    t = F.regexp_replace(F.lower(F.trim(v)), r"[^a-z0-9&+./ -]+", "")
    return F.substring(F.regexp_replace(t, r"[ ./]+", "_"), 1, limit)


def sanitized_event(name: Column, properties: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """The allowed, non-empty properties with normalised values; null for an event that is not on the list."""
    lists = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.try_element_at(lists, name)
    kept = F.map_filter(properties, lambda k, v: F.array_contains(own, k) & v.isNotNull())
    values = F.transform_values(kept, lambda k, v: normalized_value(v))
    return F.when(own.isNotNull(), F.map_filter(values, lambda k, v: v != ""))
