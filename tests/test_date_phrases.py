from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import date_phrases as dp
from tidemark.functions import dates

TUE = date(2026, 10, 6)


def day(text, ref=TUE):
    found = dp.find_days(text, ref)
    best = next((f for f in found if f[2]), found[0] if found else None)
    return str(best[0]) if best else None


@pytest.mark.parametrize(
    "text, out",
    [
        ("tonight", "2026-10-06"), ("by EOD", "2026-10-06"), ("by the end of the day", "2026-10-06"), ("close of business", "2026-10-06"), ("tomorrow morning", "2026-10-07"), ("the day after tomorrow", "2026-10-08"),
        ("Friday", "2026-10-09"), ("by Tuesday", "2026-10-06"), ("on Monday", "2026-10-12"), ("next Tuesday", "2026-10-13"), ("this coming Tuesday", "2026-10-13"), ("by Fri.", "2026-10-09"), ("on Thu", "2026-10-08"), ("Fri", None), ("the samples sat there", None),
        ("EOW", "2026-10-09"), ("later this week", "2026-10-09"), ("early next week", "2026-10-12"), ("by the end of next week", "2026-10-16"),
        ("October 14th, 2026", "2026-10-14"), ("Oct. 14", "2026-10-14"), ("Sept 3", "2026-09-03"), ("Friday, October 9", "2026-10-09"), ("the 14th of October", "2026-10-14"), ("3 March 2027", "2027-03-03"), ("March 3", "2027-03-03"), ("Aug 1", "2026-08-01"),
        ("2026-10-20", "2026-10-20"), ("due 10/14", "2026-10-14"), ("10/14/26", "2026-10-14"), ("3/4 of them", None), ("24/7 support", None), ("2/30", None), ("by the 14th", "2026-10-14"), ("the 21st century", None),
        ("in 3 days", "2026-10-09"), ("in two weeks", "2026-10-20"), ("within 30 days", "2026-11-05"), ("in a week", "2026-10-13"), ("in 2 months", "2026-12-06"), ("in 5 business days", "2026-10-13"), ("a couple of weeks from now", "2026-10-20"),
        ("by end of month", "2026-10-31"), ("end of next month", "2026-11-30"), ("end of the quarter", "2026-12-31"), ("end of Q1", "2027-03-31"), ("end of Q3", "2026-09-30"), ("year-end", "2026-12-31"),
        ("mid-November", "2026-11-15"), ("middle of January", "2027-01-15"), ("end of November", "2026-11-30"), ("beginning of December", "2026-12-01"), ("no dates at all", None), ("", None),
    ],
)
def test_phrases(text, out):
    assert day(text) == out


@pytest.mark.parametrize("text, ref, out", [("end of the week", date(2026, 10, 10), "2026-10-16"), ("next week", date(2026, 10, 11), "2026-10-12"), ("next week", date(2026, 12, 30), "2027-01-04"), ("the 31st", date(2026, 11, 5), "2026-12-31"), ("EOM", date(2026, 2, 10), "2026-02-28"), ("December 20", date(2027, 1, 5), "2026-12-20")])
def test_phrases_elsewhere_in_the_year(text, ref, out):
    assert day(text, ref) == out


def test_firmness_and_phrase():
    assert dp.find_days("Please send it by Friday.", TUE) == [(date(2026, 10, 9), "by Friday", True)]
    assert dp.find_days("Can we meet on Friday, October 9 at 2pm?", TUE) == [(date(2026, 10, 9), "on Friday, October 9", False)]
    for t in ("no later than Friday", "before Friday", "due by Oct 14", "deadline: Oct 14", "within 10 days", "The deadline for the pre-read is Monday"):
        assert dp.find_days(t, TUE)[0][2], t
    both = "Let's talk on Monday, but please send it by Friday."
    assert len(dp.find_days(both, TUE)) == 2 and day(both) == "2026-10-09"


def test_column_with_local_days(spark):
    rows = spark.createDataFrame([("by Friday", "2026-10-09 02:00:00"), ("today", "2026-10-09 02:00:00"), (None, None)], "t string, at string")
    found = rows.select("t", dp.deadline(dp.date_phrases("t", dates.local_day(F.col("at").cast("timestamp"), "America/New_York"))).alias("d")).collect()
    assert {r["t"]: str(r["d"]["day"]) if r["d"] else None for r in found} == {"by Friday": "2026-10-09", "today": "2026-10-08", None: None}
