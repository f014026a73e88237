"""Media time: ``M:SS`` and ``H:MM:SS`` labels, seconds, SRT stamps and deep links, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last cue of a transcript is taken to last so many seconds.
LAST_CUE_SECONDS = 3


def leading_int(part: Column) -> Column:
    """The whole number a text starts with, as lenient parsers read it; null if there is none."""
    return F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("int")


def _parts(time: Column) -> Column:
    return F.split(time, ":", -1)


def _part(time: Column, i: int) -> Column:
    return F.get(_parts(time), F.lit(i))


def parse_seconds(time: Column) -> Column:
    """Seconds of ``M:SS`` or ``H:MM:SS``; 0 for any other number of parts; null where a part is no number."""
    a, b, c = (leading_int(_part(time, i)) for i in range(3))
    return (
        F.when(F.size(_parts(time)) == 2, a * 60 + b)
        .when(F.size(_parts(time)) == 3, a * 3600 + b * 60 + c)
        .when(time.isNotNull(), F.lit(0))
    )


def label(seconds: Column) -> Column:
    """``H:MM:SS`` from one hour on, else ``M:SS``; fractions are cut off."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).when(
        seconds.isNotNull(), F.format_string("%d:%02d", m, r)
    )


def minutes_label(seconds: Column) -> Column:
    """``M:SS`` whatever the length: minutes are not carried into hours."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))


def deep_link(url: Column, start: Column) -> Column:
    """The url with ``t={whole seconds}s`` added to its query."""
    join = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, join, F.lit("t="), F.floor(start).cast("long").cast("string"), F.lit("s"))


def pad2(text: Column) -> Column:
    """Zeros in front up to two characters; longer texts stay whole."""
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _two(n: Column) -> Column:
    return pad2(n.cast("long").cast("string"))


def srt_stamp(time: Column) -> Column:
    """``HH:MM:SS,000``; minutes of a two-part time are carried into hours, three parts are padded as they are."""
    m, s = leading_int(_part(time, 0)), leading_int(_part(time, 1))
    two = F.concat(_two(F.floor(m / 60)), F.lit(":"), _two(m % 60), F.lit(":"), _two(s))
    three = F.concat_ws(":", *[pad2(_part(time, i)) for i in range(3)])
    body = F.when(F.size(_parts(time)) == 2, two).when(F.size(_parts(time)) == 3, three).otherwise(F.lit("00:00:00"))
    return F.concat(body, F.lit(",000"))


def minutes_stamp(time: Column) -> Column:
    """``00:MM:SS,000`` of a two-part time, whatever its length; other times as ``srt_stamp``."""
    m, s = leading_int(_part(time, 0)), leading_int(_part(time, 1))
    two = F.concat(F.lit("00:"), _two(m), F.lit(":"), _two(s), F.lit(",000"))
    return F.when(F.size(_parts(time)) == 2, two).otherwise(srt_stamp(time))


def add_seconds(time: Column, seconds: int) -> Column:
    """Two parts stay ``MM:SS`` without a carry into hours, three stay ``HH:MM:SS``; anything else is ``00:03``."""
    total = parse_seconds(time) + seconds
    two = F.concat(_two(F.floor(total / 60)), F.lit(":"), _two(total % 60))
    three = F.concat(
        _two(F.floor(total / 3600)), F.lit(":"), _two(F.floor(total % 3600 / 60)), F.lit(":"), _two(total % 60)
    )
    return F.when(F.size(_parts(time)) == 2, two).when(F.size(_parts(time)) == 3, three).otherwise(F.lit("00:03"))
