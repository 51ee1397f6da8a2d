"""Dates in any order of their parts."""

from datetime import date

import pytest

from reviewmill.functions.dates import parse_date
from pyspark.sql import functions as F

D = date(2023, 3, 5)
FORMS = {
    # the month comes first, unless it cannot be one
    "3/5/2023": D, "03-05-2023": D, "3.5.2023": D, "25/3/2023": date(2023, 3, 25), "13-12-2022": date(2022, 12, 13),
    "2023-03-05": D, "2023/3/5": D, "2023.03.05": D, "20230305": D, "2023-25-03": date(2023, 3, 25), "2023 3 5": D,
    # names in any order, ordinals, day names
    "5 March 2023": D, "March 5, 2023": D, "Mar 5 2023": D, "2023 March 5": D, "5th of March, 2023": D, "the 5th March 2023": D,
    "Sunday, March 5th, 2023": D, "Sun 5 Mar 2023": D, "sunday 5. march 2023": D, "5-Mar-2023": D, "5MAR2023": D,
    "Sept 1st 2023": date(2023, 9, 1), "May 2 2023": date(2023, 5, 2), "wednesday 1 june 2022": date(2022, 6, 1),
    # two-digit years
    "3/5/23": D, "5 March 23": D, "March 5 '23": D, "31/12/68": date(2068, 12, 31), "12/31/69": date(1969, 12, 31), "99-03-05": date(1999, 3, 5),
    "25.3.23": date(2023, 3, 25),
    # a period begins
    "2023": date(2023, 1, 1), "2023-03": date(2023, 3, 1), "3/2023": date(2023, 3, 1), "March 2023": date(2023, 3, 1), "2023 march": date(2023, 3, 1),
    # a time of day does not count
    "2023-03-05T10:11:12Z": D, "2023-03-05 10:11:12.5+02:00": D, "March 5, 2023 1:02 PM": D, "  2023-03-05 ": D, "29 Feb 2024": date(2024, 2, 29),
    # no dates
    "": None, " ": None, "yesterday": None, "about 2000": None, "March 5": None, "5": None, "3/5": None, "30 Feb 2023": None, "2023-13-32": None,
    "5/2023/3": None, "1 2 3 4": None, "marching 5 2023": None, "2023-00-10": None, "13/13/2023": None, "20231305": None, "123456": None, "march": None,
    "99999999999999999999": None, "3rd": None, "Sunday": None, "5 March 2023 3": None,
}


def test_forms(spark):
    rows = spark.createDataFrame([(t,) for t in FORMS] + [(None,)], "t string")
    got = {r.t: r.d for r in rows.select("t", parse_date(F.col("t")).alias("d")).collect()}
    assert got.pop(None) is None
    assert {t: got[t] for t in FORMS if got[t] != FORMS[t]} == {}


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%d %B %Y", "%b %d, %Y", "%A %d %b %Y", "%m/%d/%Y", "%Y%m%d", "%d-%b-%y", "%B %dth %Y"])
def test_every_day_of_some_years(spark, form):
    days = [date(1999 + i % 40, 1 + i % 12, 1 + i % 28) for i in range(400)]
    rows = spark.createDataFrame([(d.strftime(form), d) for d in days], "t string, d date")
    assert rows.where(~parse_date(F.col("t")).eqNullSafe(F.col("d"))).count() == 0
