"""Sending windows: times of day by weekday and holiday. A window is a map from mon..sun and hol to arrays of from/to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = "map<string,array<struct<`from`:string,`to`:string>>>"
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def easter(year: int) -> dt.date:
    """Easter Sunday, by the anonymous Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    d, e, f = b // 4, b % 4, (b + 8) // 25
    h = (19 * a + b - d - (b - f + 1) // 3 + 15) % 30
    k = (32 + 2 * e + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def german_holidays(year: int) -> list[dt.date]:
    """Holidays of all German states."""
    e = easter(year)
    moving = [e + dt.timedelta(days=n) for n in (-2, 1, 39, 50)]
    return sorted([dt.date(year, 1, 1), dt.date(year, 5, 1), dt.date(year, 10, 3), dt.date(year, 12, 25), dt.date(year, 12, 26), *moving])


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.createDataFrame([(d,) for y in range(first, last + 1) for d in german_holidays(y)], "day date")


def minutes(c: Column) -> Column:
    """Minutes of the day of HH:MM; null if it isn't one."""
    h, m = (F.get(F.split(F.trim(c), ":", 2), F.lit(i)).try_cast("int") for i in (0, 1))
    return F.when(F.contains(c, F.lit(":")) & h.between(0, 23) & m.between(0, 59), h * 60 + m)


def day_key(day: Column, years: tuple[int, int]) -> Column:
    """hol on a holiday, else the weekday."""
    free = [d for y in range(years[0], years[1] + 1) for d in german_holidays(y)]
    week = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.weekday(day) + 1)
    return F.when(day.isin(free), "hol").otherwise(week)


def spans(window: Column, key: Column) -> Column:
    """The day's slots as structs of minutes (a, b); those that aren't times, or end before they begin, are left out."""
    slots = F.coalesce(F.try_element_at(window, key), F.array().cast("array<struct<`from`:string,`to`:string>>"))
    pairs = F.transform(slots, lambda s: F.struct(minutes(s["from"]).alias("a"), minutes(s["to"]).alias("b")))
    return F.filter(pairs, lambda s: s["a"].isNotNull() & s["b"].isNotNull() & (s["b"] > s["a"]))


def window_minutes(slots: Column) -> Column:
    """Minutes in all; overlaps count twice."""
    return F.aggregate(slots, F.lit(0), lambda t, s: t + s["b"] - s["a"])


def in_window(slots: Column, now: Column) -> Column:
    return F.exists(slots, lambda s: (s["a"] <= now) & (now < s["b"]))


def remaining(slots: Column, now: Column) -> Column:
    """Minutes of the day's slots that are still to come."""
    return F.aggregate(slots, F.lit(0), lambda t, s: t + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], now)))


def nonempty(window: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(window), lambda v: F.size(v) > 0), F.lit(False))


def effective(campaign: Column, workspace: Column, everywhere: Column) -> Column:
    """The first window that has any slot."""
    return F.coalesce(*[F.when(nonempty(w), w) for w in (campaign, workspace, everywhere)], F.create_map().cast(WINDOW))


def next_start(window: Column, now: Column, years: tuple[int, int], ahead: int = 15) -> Column:
    """The next time inside the window (local wall clock): now, if it is in a slot, or the first start after it within so
    many days; now, if there is none."""
    today = F.to_date(now)
    cur = F.hour(now) * 60 + F.minute(now)

    def starts(i: Column) -> Column:
        day = F.date_add(today, i)
        slots = spans(window, day_key(day, years))
        later = F.filter(slots, lambda s: (i > 0) | (cur < s["a"]))
        return F.transform(later, lambda s: day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), s["a"]))

    found = F.array_min(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ahead - 1)), starts)))
    return F.when(in_window(spans(window, day_key(today, years)), cur), now).otherwise(F.coalesce(found, now))


def shared_interval_ms(total_minutes: Column, campaigns: Column, limit_hour: Column, limit_day: Column) -> Column:
    """Milliseconds between letters of campaigns that share a mailbox on one day; null without minutes or limits."""
    ok = (total_minutes > 0) & (campaigns > 0) & (limit_hour > 0) & (limit_day > 0)
    return F.when(ok, F.ceil(F.greatest(total_minutes * 60000.0 / F.when(limit_day > 0, limit_day), campaigns * 3600000.0 / F.when(limit_hour > 0, limit_hour))).cast("long"))


def normalised(window: Column) -> Column:
    """A window with every day and the holiday, each with its list of slots, empty if it has none."""
    none = F.array().cast("array<struct<`from`:string,`to`:string>>")
    return F.map_from_arrays(F.array(*[F.lit(d) for d in (*DAYS, "hol")]), F.array(*[F.coalesce(F.try_element_at(window, F.lit(d)), none) for d in (*DAYS, "hol")]))


def local_text(utc: Column, zone: str = "Europe/Berlin") -> Column:
    """A UTC time on local clocks, day and month first."""
    return F.date_format(F.from_utc_timestamp(utc.cast("timestamp"), zone), "dd.MM HH:mm")


def months_ahead(day: Column) -> dict[str, Column]:
    """A date, and those one and three months later; the last day of a shorter month stands for days that it lacks."""
    return {"date": F.to_date(day), "date_plus_1m": F.add_months(day, 1), "date_plus_3m": F.add_months(day, 3)}
