"""Record and archive names.

Record names carry the valid time of a record; archive names carry the first
and last day of the period they hold. All parsing is strict: a name that does
not match the whole pattern (wrong prefix, month 13, trailing text) gives
null, never a wrong time. Parsing never depends on the session time zone:
names are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.schemas import (
    ARCHIVE_NAME_REGEX,
    ARCHIVE_PERIOD_DAYS,
    ARCHIVE_PERIODS_PER_MONTH,
    ARCHIVE_PREFIX,
    ARCHIVE_SUFFIX,
    DECODED_SUFFIX,
    RECORD_NAME_PATTERN,
)

_UTC_SUFFIX = " +0000"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_time(name, pattern: str = RECORD_NAME_PATTERN) -> Column:
    """record name -> timestamp (UTC instant); null when it does not parse."""
    return F.try_to_timestamp(F.concat(_col(name), F.lit(_UTC_SUFFIX)), F.lit(pattern + " Z"))


def record_time_ms(name, pattern: str = RECORD_NAME_PATTERN) -> Column:
    """F1 as epoch milliseconds (the original ``Long`` form)."""
    return F.unix_millis(record_time(name, pattern))


def record_name_for(ts, pattern: str = RECORD_NAME_PATTERN) -> Column:
    """Inverse of F1 for a wall-clock (``timestamp_ntz``) or UTC timestamp."""
    return F.date_format(_col(ts), pattern)


def decoded_name(name) -> Column:
    """``x.grb2`` -> ``x.nc`` (only a trailing suffix is replaced)."""
    return F.regexp_replace(_col(name), r"\.grb2$", DECODED_SUFFIX)


def join_path(root, name) -> Column:
    """root folder + file name."""
    root_col = F.lit(root) if isinstance(root, str) else root
    return F.concat_ws("/", F.regexp_replace(root_col, "/+$", ""), _col(name))


def is_archive(name) -> Column:
    """Does the file name denote a tar archive."""
    return _col(name).endswith(ARCHIVE_SUFFIX)


def _archive_day(name, group: int) -> Column:
    digits = F.regexp_extract(_col(name), ARCHIVE_NAME_REGEX, group)
    return F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd")


def archive_first_day(name) -> Column:
    """first day covered by an archive (date), null if the name is malformed."""
    return _archive_day(name, 1)


def archive_last_day(name) -> Column:
    """last day covered by an archive (date)."""
    return _archive_day(name, 2)


def archive_name_for(ts) -> Column:
    """Name of the archive holding a record taken at ``ts``.

    Day d of a month falls in period min((d-1) div 5, 5); the last period runs
    to the month end.
    """
    t = _col(ts)
    day = F.dayofmonth(t)
    period = F.least((day - 1) / ARCHIVE_PERIOD_DAYS, F.lit(ARCHIVE_PERIODS_PER_MONTH - 1)).cast("int")
    first = F.make_date(F.year(t), F.month(t), period * ARCHIVE_PERIOD_DAYS + 1)
    last = F.when(period == ARCHIVE_PERIODS_PER_MONTH - 1, F.last_day(t)).otherwise(
        F.date_add(first, ARCHIVE_PERIOD_DAYS - 1)
    )
    return F.concat(
        F.lit(ARCHIVE_PREFIX),
        F.date_format(first, "yyyyMMdd"),
        F.lit("-"),
        F.date_format(last, "yyyyMMdd"),
        F.lit(ARCHIVE_SUFFIX),
    )


def utc_wall_clock(frame, ts_col: str) -> Column:
    """A time column as UTC wall-clock (``timestamp_ntz``), whatever the
    session zone: instants (``timestamp``) are converted from the session
    zone, wall-clock values (``timestamp_ntz``) are taken as UTC already."""
    from pyspark.sql.types import TimestampNTZType

    if isinstance(frame.schema[ts_col].dataType, TimestampNTZType):
        return F.col(ts_col)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(ts_col).cast("timestamp_ntz"))
