"""Calendar days, instants and the owner's local time, all relative to explicit arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(instant: Column, tz: str) -> Column:
    """The calendar day that an instant (UTC) falls on in the time zone."""
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), tz))


def day_start(day: Column, tz: str) -> Column:
    """The instant (UTC) of local midnight, across daylight saving changes."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def minute_of_day(instant: Column, tz: str) -> Column:
    local = F.from_utc_timestamp(instant.cast("timestamp"), tz)
    return F.hour(local) * 60 + F.minute(local)


def parse_day(text: Column) -> Column:
    """Strict YYYY-MM-DD, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def days_between_instants(start: Column, end: Column) -> Column:
    """Whole days between instants, rounded half up: a day and a half are two."""
    return F.floor((F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / 86_400_000 + 0.5)


def week_start(day: Column) -> Column:
    """The Monday of the day's week."""
    return F.trunc(day, "WEEK")


def quarter_key(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def in_work_hours(instant: Column, tz: str, first: int = 7 * 60, last: int = 19 * 60) -> Column:
    """Monday to Friday, from the first local minute up to the last one, which is left out."""
    minute = minute_of_day(instant, tz)
    return (F.weekday(local_day(instant, tz)) < 5) & (minute >= first) & (minute < last)


def add_business_days(day: Column, n: Column) -> Column:
    """n weekdays after day (n >= 0). A weekend counts as the Friday before, in closed form."""
    back = F.greatest(F.lit(0), F.weekday(day) - 4)
    friday = F.date_sub(day, back)
    place = F.weekday(friday) + n
    return F.when(n <= 0, day).otherwise(F.date_add(friday, (n + 2 * F.floor(place / 5)).cast("int")))


def relative_day(day: Column, today: Column) -> Column:
    """Today, Tomorrow, Yesterday, '3d overdue', 'in 4d' up to a week, 'in 3w' up to 60 days, else the day."""
    n = F.datediff(day, today)
    return (
        F.when(n == 0, "Today").when(n == 1, "Tomorrow").when(n == -1, "Yesterday")
        .when(n < 0, F.concat((-n).cast("string"), F.lit("d overdue")))
        .when(n < 7, F.concat(F.lit("in "), n.cast("string"), F.lit("d")))
        .when(n < 60, F.concat(F.lit("in "), F.floor(n / 7 + 0.5).cast("string"), F.lit("w")))
        .otherwise(day_key(day))
    )


def time_ago(instant: Column, now: Column) -> Column:
    """'just now', then whole minutes, hours, days, and months of 30 days."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(instant.cast("timestamp"))) / 60_000)
    say = lambda x, unit: F.concat(x.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m"))
        .when(minutes < 1440, say(F.floor(minutes / 60), "h")).when(minutes < 43_200, say(F.floor(minutes / 1440), "d"))
        .otherwise(say(F.floor(minutes / 43_200), "mo"))
    )


def excel_day(serial: Column, epoch_1904: bool = False) -> Column:
    """The day of a spreadsheet's serial number."""
    return F.date_add(F.lit("1904-01-01" if epoch_1904 else "1899-12-30").cast("date"), F.floor(serial).cast("int"))
