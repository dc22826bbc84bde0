"""Numbers, dates and small decisions as Column functions. Times are given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def recency(published: Column, as_of: Column) -> Column:
    """1 / (1 + ln(1 + hours / 4)); 0.5 where there is no time or the formula has no value."""
    x = hours_between(as_of, published) / 4
    return F.coalesce(F.try_divide(F.lit(1.0), F.lit(1.0) + F.when(x > -1, F.log1p(x))), F.lit(0.5))


def engagement_boost(count: Column) -> Column:
    return F.log1p(count.cast("double")) * 0.1


def serendipity(*keys: Column) -> Column:
    """0 to 0.099 by a hash of the keys: the same in every run."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100) / 1000.0


def duration_text(seconds: Column) -> Column:
    """45s, 12m, 2h or 2h 5m."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("long").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(minutes > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h")))
    )


def parsed_tags(text: Column) -> Column:
    """A JSON array of strings; empty where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def merged_tags(new: Column, old: Column, most: int = 10) -> Column:
    """New and then old tags, each once, at most that many."""
    return F.slice(F.array_union(new, old), 1, most)


def cleaned_tags(tags: Column, most: int = 5) -> Column:
    """Tags that are not null or empty, trimmed, the first ones."""
    return F.slice(F.transform(F.filter(tags, lambda t: t != ""), lambda t: F.trim(t)), 1, most)


def ascii_json(tags: Column) -> Column:
    """A JSON array of strings in which every character beyond ASCII is written as an escape of its UTF-16 units."""

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        point = F.ascii(c)
        pair = F.concat(unit(F.shiftright(point - 0x10000, 10) + 0xD800), unit(((point - 0x10000) % 0x400) + 0xDC00))
        return F.when(point < 128, c).when(point < 0x10000, unit(point)).otherwise(pair)

    def quoted(tag: Column) -> Column:
        listed = F.to_json(F.array(tag))
        return F.substring(listed, F.lit(2), F.char_length(listed) - 2)

    whole = F.concat(F.lit("["), F.array_join(F.transform(tags, quoted), ", "), F.lit("]"))
    return F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0)), escaped), "")


def salted_hash(text: Column) -> Column:
    return F.sha2(text, 256)
