"""Integer-microsecond time maths and time-code text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_MS = 1_000
DEFAULT_FPS = 30


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_half_up(value: Column) -> Column:
    """Nearest integer with halves going up, also for negative values."""
    return F.floor(value + F.lit(0.5)).cast("long")


def us_from_seconds(seconds: Column) -> Column:
    return round_half_up(seconds * F.lit(float(US_PER_SECOND)))


def us_from_ms(ms: Column) -> Column:
    return round_half_up(ms * F.lit(float(US_PER_MS)))


def ms(value: float) -> int:
    """Plain-number milliseconds to microseconds, for option values."""
    return int(round(value * US_PER_MS))


def int_div(value: Column, by: int) -> Column:
    """Floor division of non-negative longs."""
    return F.floor(value / F.lit(by)).cast("long")


def snap_to_frame(us: Column, fps: int = DEFAULT_FPS) -> Column:
    frame_us = int(US_PER_SECOND / fps + 0.5)
    return round_half_up(us / F.lit(frame_us)) * F.lit(frame_us)


def frame_index(us: Column, fps: int = DEFAULT_FPS) -> Column:
    frame_us = US_PER_SECOND / fps
    return F.greatest(F.lit(0), F.floor(us / F.lit(frame_us) + F.lit(1e-9))).cast("long")


def frame_to_us(frame: Column, fps: int = DEFAULT_FPS) -> Column:
    return round_half_up(frame * F.lit(US_PER_SECOND) / F.lit(fps))


def clamp_us(us: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(high, F.greatest(low, us))


def _pad(value: Column, width: int) -> Column:
    """Left-pad with zeros without cutting longer numbers."""
    text = value.cast("long").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def _digits(value: Column, width: int) -> Column:
    """``_pad`` of a number that has no more digits, which is computed once."""
    return F.lpad(value.cast("long").cast("string"), width, "0")


def _parts(us: Column) -> tuple[Column, Column, Column, Column]:
    t = F.greatest(F.lit(0), us).cast("long")
    hours = int_div(t, 3_600_000_000)
    minutes = int_div(t, 60_000_000)
    seconds = int_div(t, US_PER_SECOND)
    return t, hours, minutes, seconds


def clock(us: Column) -> Column:
    _, _, minutes, seconds = _parts(us)
    return F.concat(_pad(minutes, 2), F.lit(":"), _pad(seconds % 60, 2))


def timecode(us: Column, with_frames: bool = False, fps: int = DEFAULT_FPS) -> Column:
    t, _, minutes, seconds = _parts(us)
    tail = frame_index(t, fps) % fps if with_frames else int_div(t % US_PER_SECOND, 10_000)
    return F.concat(_pad(minutes, 2), F.lit(":"), _pad(seconds % 60, 2), F.lit("."), _pad(tail, 2))


def _hms(us: Column) -> tuple[Column, Column]:
    t, hours, minutes, seconds = _parts(us)
    head = F.concat(_pad(hours, 2), F.lit(":"), _digits(minutes % 60, 2), F.lit(":"), _digits(seconds % 60, 2))
    return head, _digits(int_div(t, 1_000) % 1_000, 3)


def srt_stamp(us: Column) -> Column:
    head, millis = _hms(us)
    return F.concat(head, F.lit(","), millis)


def vtt_stamp(us: Column) -> Column:
    head, millis = _hms(us)
    return F.concat(head, F.lit("."), millis)


def lrc_stamp(us: Column) -> Column:
    t, _, minutes, seconds = _parts(us)
    return F.concat(
        F.lit("["), _pad(minutes, 2), F.lit(":"), _pad(seconds % 60, 2), F.lit("."),
        _pad(int_div(t, 10_000) % 100, 2), F.lit("]"),
    )


def ass_stamp(us: Column) -> Column:
    t, hours, minutes, seconds = _parts(us)
    return F.concat(
        hours.cast("string"), F.lit(":"), _pad(minutes % 60, 2), F.lit(":"), _pad(seconds % 60, 2),
        F.lit("."), _pad(int_div(t, 10_000) % 100, 2),
    )


CLOCK = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$"


def parse_clock(text: Column) -> Column:
    """``[h:]m:s[.frac]`` to microseconds; null unless minutes and seconds are at most 59."""
    s = F.trim(text)

    def part(i: int) -> Column:
        return F.regexp_extract(s, CLOCK, i)

    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("long"), F.lit(0))

    hours, minutes, seconds = number(part(1)), number(part(2)), number(part(3))
    millis = number(F.rpad(part(4), 3, "0"))
    value = ((hours * 3600 + minutes * 60 + seconds) * 1000 + millis) * 1000
    ok = s.rlike(CLOCK) & (minutes <= 59) & (seconds <= 59)
    return F.when(ok, value)


FORMATS = {
    "srt": srt_stamp,
    "vtt": vtt_stamp,
    "lrc": lrc_stamp,
    "ass": ass_stamp,
    "clock": clock,
    "timecode": timecode,
    "frames": lambda us: timecode(us, with_frames=True),
}


def render(us: Column, fmt: str) -> Column:
    return FORMATS[fmt](us)
