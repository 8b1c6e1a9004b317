"""Expressions over numbers, arrays, maps, hashes and JSON (MTH, ARR, MAP, HSH, JSN)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """MTH03: a share, `empty` where the whole is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def content_hash(content: Column) -> Column:
    """HSH01: hex SHA-256 of bytes or text."""
    return F.sha2(content, 256)


def holdout_size(n: Column, holdout: float) -> Column:
    """MTH04: at least one."""
    return F.greatest(F.lit(1), F.floor(n * holdout)).cast("long")


def shuffle_rank(key: Column, seed: int) -> Column:
    """MTH05: a reproducible order that SQL can repeat, in place of a generator's state."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def overlap(a: Column, b: Column) -> Column:
    """MTH06: Jaccard similarity of two token arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def lookup(m: Column, key: Column | str, default: Column) -> Column:
    """MAP01: a JSON null counts as missing."""
    return F.coalesce(F.try_element_at(m, key if isinstance(key, Column) else F.lit(key)), default)


def merge_missing(existing: Column, defaults: Column) -> Column:
    """MAP02: adds keys that are missing, after the existing ones; never overwrites."""
    return F.map_concat(existing, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(existing, k)))


def missing(required: Column, present: Column) -> Column:
    """SET03."""
    return F.array_except(required, present)


def joined(*arrays: Column) -> Column:
    """SET06: arrays one after the other, null ones as empty."""
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def head_and_rest(items: Column, n: int = 3) -> tuple[Column, Column]:
    """LIM01, ARR01: the first n items and how many more there are."""
    return F.slice(items, 1, n), F.greatest(F.lit(0), F.size(items) - n)


def json_long(c: Column, path: str, default: int) -> Column:
    """JSN01, MAP01."""
    return F.coalesce(F.get_json_object(c, path).cast("long"), F.lit(default).cast("long"))


def now_iso(clock: Column | None = None) -> Column:
    """DAT01: a UTC time stamp; the clock is a parameter for tests."""
    return F.date_format(clock if clock is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def today(clock: Column | None = None) -> Column:
    """DAT02."""
    return F.date_format(clock if clock is not None else F.current_date(), "yyyy-MM-dd")


def rounded(c: Column, digits: int) -> Column:
    """MTH01: half away from zero, on the decimal that the number shows."""
    return F.round(c, digits)


def any_of(items: Column, holds) -> Column:
    """ARR02: whether it holds for some item."""
    return F.exists(items, holds)


def all_of(items: Column, holds) -> Column:
    """ARR02: whether it holds for every item; true of none."""
    return F.forall(items, holds)


def any_in(items: Column, names: tuple[str, ...]) -> Column:
    """ARR02: whether some item is one of the names."""
    return F.arrays_overlap(items, F.array(*[F.lit(n) for n in names]))


def random_id() -> Column:
    """HSH03: eight hex digits, new at each evaluation; nothing that is compared may depend on it."""
    return F.substring(F.uuid(), 1, 8)


def distinct_values(*columns) -> Column:
    """AGG04: the distinct values of a group in order, as an aggregate."""
    return F.array_sort(F.collect_set(*columns))
