"""Load duration of a log row, as seconds and as display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Display units of a duration (seconds, minutes, hours).
UNIT_SECONDS = "초"
UNIT_MINUTES = "분"
UNIT_HOURS = "시간"


def duration_seconds(started, finished) -> Column:
    """Elapsed wall-clock seconds (fractional), NTZ difference without zones."""
    s = F.col(started) if isinstance(started, str) else started
    f = F.col(finished) if isinstance(finished, str) else finished
    return F.timestamp_diff("MICROSECOND", s, f).cast("double") / F.lit(1e6)


def duration_text(secs) -> Column:
    """``x.x초`` below a minute, ``m분 s초`` below an hour, else ``h.h시간``."""
    s = F.col(secs) if isinstance(secs, str) else secs
    minutes = F.floor(s / 60).cast("long")
    seconds = (F.floor(s) % 60).cast("long")
    return (
        F.when(s < 60, F.concat(F.format_string("%.1f", s), F.lit(UNIT_SECONDS)))
        .when(s / 60 < 60, F.concat(minutes.cast("string"), F.lit(UNIT_MINUTES + " "),
                                    seconds.cast("string"), F.lit(UNIT_SECONDS)))
        .otherwise(F.concat(F.format_string("%.1f", s / 3600), F.lit(UNIT_HOURS)))
    )
