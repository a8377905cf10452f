"""Lookups by time where months are missing, which the tables of asof_clamped have none of."""
from courtside.operators.joins import as_of_clamped


def test_clamped_where_months_are_missing(spark):
    months = spark.createDataFrame([(1, "2020-02", 5.0), (1, "2020-06", 7.0), (1, "2020-04", 9.0)], "k long, month string, v double")
    asked = spark.createDataFrame([(10, 1, "2019-12"), (11, 1, "2020-02"), (12, 1, "2020-04"), (13, 1, "2020-05"), (14, 1, "2021-01"), (15, 2, "2020-02")], "o long, k long, month string")
    got = {r.o: r.v for r in as_of_clamped(asked, months, "k", "month", "v").collect()}
    assert got == {10: 5.0, 11: 5.0, 12: 9.0, 13: 7.0, 14: 7.0}  # a gap takes the last value, a key without values goes
