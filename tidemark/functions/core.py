"""Column helpers used by several operator modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KST = "Asia/Seoul"


class PointInTimeError(ValueError):
    """A table breaks a rule of its contract; the violations are named in the message."""


def known(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def raise_on(violations: DataFrame, what: str) -> None:
    """Strict mode: raise with a few rows of a violations table unless it is empty."""
    found = violations.limit(5).collect()
    if found:
        raise PointInTimeError(f"{what}: {[r.asDict() for r in found]}")


def strict_int(c: Column) -> Column:
    """'1,234' to long; NULL for blank or non-integral text."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d{1,3}(?:,\d{3})*$|^[+-]?\d+$"), F.regexp_replace(F.trim(c), ",", "").try_cast("bigint"))


def strict_decimal(c: Column) -> Column:
    """'1,234.5' to decimal(38,6); NULL for blank or other text."""
    return F.when(F.trim(c).rlike(r"^[+-]?[\d,]+(?:\.\d+)?$"), F.regexp_replace(F.trim(c), ",", "").try_cast("decimal(38,6)"))


def parse_day(c: Column) -> Column:
    """yyyymmdd or yyyy-mm-dd to date; NULL for anything else."""
    digits = F.regexp_replace(F.trim(c), "-", "")
    return F.when(digits.rlike(r"^\d{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def kst_instant(day: Column, hour: int, minute: int = 0) -> Column:
    """The instant of a KST wall-clock time on a date."""
    local = F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {hour:02d}:{minute:02d}:00")))
    return F.to_utc_timestamp(local, KST)


def kst_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, KST))


def decision_day(instant: Column, hour: int = 18) -> Column:
    """The KST date whose decision, taken at an hour, an instant is known to: its own up to the hour itself, else the next."""
    return F.to_date(F.from_utc_timestamp(instant, KST) + F.make_interval(hours=F.lit(24 - hour)) - F.expr("interval 1 microsecond"))


def obs(partition: str = "instrument_id", order: str = "session") -> Window:
    """Window over observed rows."""
    return Window.partitionBy(partition).orderBy(order)


def grid(rows: int, partition: str = "instrument_id", order: str = "pos") -> Window:
    """Window over the last `rows` positions of the calendar, the current one included.

    A range of positions, so absent sessions take their slots whether the grid holds them or not.
    """
    return Window.partitionBy(partition).orderBy(order).rangeBetween(-(rows - 1), 0)


def roll_sum(x: Column, w: int) -> Column:
    return F.sum(F.coalesce(x, F.lit(0.0))).over(grid(w))


def roll_count(x: Column, w: int) -> Column:
    return F.count(x).over(grid(w))


def roll_mean(x: Column, w: int, least: int | None = None) -> Column:
    """Mean of the known values of a window; NULL with fewer than least of them."""
    return F.when(roll_count(x, w) >= (max(2, w // 2) if least is None else least), F.avg(x).over(grid(w)))


def roll_std(x: Column, w: int, least: int | None = None) -> Column:
    """Population deviation of the known values of a window."""
    return F.when(roll_count(x, w) >= (max(3, w // 2) if least is None else least), F.stddev_pop(x).over(grid(w)))


def roll_max(x: Column, w: int, least: int) -> Column:
    return F.when(roll_count(x, w) >= least, F.max(x).over(grid(w)))


def roll_min(x: Column, w: int, least: int) -> Column:
    return F.when(roll_count(x, w) >= least, F.min(x).over(grid(w)))


def shifted(x: Column, k: int) -> Column:
    """Value k positions ago, NULL if that session is absent; of the future where k is negative."""
    return F.first(x).over(Window.partitionBy("instrument_id").orderBy("pos").rangeBetween(-k, -k))


def lag_ratio(x: Column, k: int) -> Column:
    past = shifted(x, k)
    return F.when(past > 0, x / past - 1)
