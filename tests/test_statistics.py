from datetime import date, datetime

from pyspark.sql import functions as F

from readlake.functions import dates as D
from readlake.operators import statistics as S

DAYS = "library bigint, folder string, is_archived boolean, ord bigint, title string, dateKey string, charactersRead bigint, readingTime double, lastStatisticModified bigint"


def days(spark, rows):
    return spark.createDataFrame([(0, f, a, o, f.upper(), k, c, t, m) for f, a, o, k, c, t, m in rows], DAYS)


def daily(spark, rows):
    return spark.createDataFrame([(0, date.fromisoformat(d), c, float(s), 1) for d, c, s in rows], "library bigint, date date, characters bigint, seconds double, books bigint")


def test_dedup_keeps_first_of_equals_and_newest(spark):
    df = days(spark, [("a", False, 0, "2026-09-01", 100, 60.0, 5), ("a", False, 1, "2026-09-01", 200, 90.0, 5), ("a", False, 2, "2026-09-02", 10, 1.0, 1), ("a", False, 3, "2026-09-02", 20, 2.0, 9), ("a", True, 4, "2026-09-03", 0, 0.0, 1), ("b", False, 5, "not-a-date", 5, 5.0, 1)])
    once = S.dedup_days(df)
    kept = {r.ord for r in S.dated(S.active_days(once)).collect()}
    assert kept == {0, 3}
    assert S.dedup_days(once).count() == once.count()


def test_streak_survives_unmet_today_and_ends_after_a_gap(spark):
    df = daily(spark, [("2026-01-01", 10, 1), ("2026-01-02", 10, 1), ("2026-01-04", 10, 1), ("2026-01-05", 10, 1), ("2026-01-06", 1, 1)])
    t = S.today_summary(df, "2026-01-06", "characters", 10).first()
    assert (t.streak, t.target_percent) == (2, 10)
    h = S.history(df, "2026-01-08", "characters", 10).first()
    assert (h.current_days, h.longest_days, h.longest_start, h.met_days, h.reading_days, h.best_day) == (0, 2, date(2026, 1, 1), 4, 5, date(2026, 1, 1))


def test_heat(spark):
    one = S.heat_levels(daily(spark, [("2026-01-01", 5, 1), ("2026-01-02", 5, 1), ("2026-01-03", 0, 1)]))
    assert sorted(r.level for r in one.collect()) == [0, 7, 7]
    two = S.heat_levels(daily(spark, [("2026-01-01", 5, 1), ("2026-01-02", 9, 1), ("2026-01-03", 900, 1)]))
    assert sorted(r.level for r in two.collect()) == [1, 4, 7]


def test_trend_fills_with_zeros_and_adds_up(spark):
    df = daily(spark, [("2026-01-05", 5, 2), ("2026-03-05", 7, 3)])
    year = S.trend(df, "year", "2026-01-01", "2026-12-31").collect()
    assert len(year) == 12 and sum(r.characters for r in year) == 12
    assert S.range_summary(df, "characters", 5).first().target_days == 2


def test_merge_tie_takes_first_argument_and_is_idempotent(spark):
    a, b = days(spark, [("a", False, 0, "2026-09-01", 1, 1.0, 5)]), days(spark, [("a", False, 1, "2026-09-01", 2, 1.0, 5), ("a", False, 2, "2026-09-02", 3, 1.0, 1)])
    m = S.merge_days(a, b)
    assert sorted(r.charactersRead for r in m.collect()) == [1, 3]
    assert sorted(r.charactersRead for r in S.merge_days(m, b).collect()) == [1, 3]
    assert sorted(r.charactersRead for r in S.merge_days(b, a).collect()) == [2, 3]


def test_reset_time_and_zone(spark):
    df = spark.createDataFrame([(datetime(2026, 6, 29, 17, 44),), (datetime(2026, 6, 29, 17, 45),)], "ts timestamp")
    assert [r[0] for r in df.select(D.statistics_date(F.col("ts"), 105, "Asia/Shanghai")).collect()] == [date(2026, 6, 29), date(2026, 6, 30)]


def test_two_speeds(spark):
    r = spark.range(1).select(D.speed(F.lit(10), F.lit(7.0)), D.speed_truncated(F.lit(10), F.lit(7.0)), D.speed(F.lit(10), F.lit(0.0))).first()
    assert tuple(r) == (5143, 5142, 0)


def test_least_speed_starts_afresh_after_zero(spark):
    rows = [(0, "a", i, 10, 1.0, m, m, 7, i) for i, m in enumerate((5, 0, 9))]
    df = spark.createDataFrame(rows, "library bigint, folder string, ord bigint, charactersRead bigint, readingTime double, minReadingSpeed bigint, altMinReadingSpeed bigint, lastReadingSpeed bigint, lastStatisticModified bigint")
    assert S.upload_summary(df).first().min_speed == 9


def test_empty_days(spark):
    empty = days(spark, [])
    assert S.daily_totals(S.dated(S.dedup_days(empty))).count() == 0
