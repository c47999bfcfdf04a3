"""Trading-session alignment and forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.asof import next_after


def local_time(utc: Column, zone: str = "America/New_York") -> Column:
    return F.from_utc_timestamp(utc.cast("timestamp_ntz").cast("timestamp"), zone)


def news_day(filed: Column, accepted_utc: Column, zone: str = "America/New_York", close_hour: int = 16) -> tuple[Column, Column]:
    """Day on which a filing became news, and whether that was after the close.

    The later of the filing day and the local day of acceptance. Without an
    acceptance time there is no day, and the filing is not after the close.
    """
    at = local_time(accepted_utc, zone)
    day = F.when(accepted_utc.isNotNull() & filed.isNotNull(), F.greatest(filed, F.to_date(at)))
    return day, F.coalesce(F.hour(at) >= close_hour, F.lit(False))


def news_sessions(events: DataFrame, sessions: DataFrame, *, day: str, late: str, session: str) -> DataFrame:
    """``events`` with ``news_session``: the first session on its news day or after it, strictly after if it came late.

    Distinct days are aligned, not events; the calendar is met by one running minimum.
    """
    calendar = sessions.select(F.lit(0).alias("_c"), F.col(session).cast("date").alias("_s")).distinct()
    days = events.select(F.lit(0).alias("_c"), F.col(day).alias("_day")).where("_day is not null").distinct()
    on = next_after(days, calendar, keys=["_c"], at="_day", when="_s", inclusive=True).select("_day", F.col("next").alias("_on"))
    after = next_after(days, calendar, keys=["_c"], at="_day", when="_s").select("_day", F.col("next").alias("_after"))
    both = on.join(after, "_day")
    joined = events.join(both, events[day] == both["_day"], "left")
    return joined.withColumn("news_session", F.when(F.col(late), F.col("_after")).otherwise(F.col("_on"))).drop("_day", "_on", "_after")


def forward_change(panel: DataFrame, entity: str, position: str, value: str, steps: int) -> DataFrame:
    """``(entity, position, change)``: relative change to the value ``steps`` positions later; null if either is missing or not positive."""
    later = panel.select(entity, (F.col(position) - steps).alias(position), F.col(value).alias("_later"))
    joined = panel.join(later, [entity, position], "left")
    fine = (F.col(value) > 0) & (F.col("_later") > 0)
    return joined.select(entity, position, F.when(fine, F.col("_later") / F.col(value) - 1).alias("change"))
