"""Queries of the statistics family and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import dates as D
from readlake.operators import statistics as S
from readlake.plans.fixtures import reading_days, table, with_

TODAY, ANCHOR, KIND, TARGET = "2024-01-25", "2024-01-17", "characters", 9000
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def once(spark, sf_dir) -> DataFrame:
    return S.dedup_days(reading_days(spark, sf_dir))


def dated(spark, sf_dir) -> DataFrame:
    return S.dated(S.active_days(once(spark, sf_dir)))


def daily(spark, sf_dir) -> DataFrame:
    """Daily totals; seconds are summed in whole milliseconds so that they do not depend on order."""
    rows = dated(spark, sf_dir).withColumn("readingTime", F.floor(F.col("readingTime") * 1000 + 0.5).cast("bigint"))
    return S.daily_totals(rows).withColumn("seconds", F.col("seconds") / 1000.0)


DAY = 'library, folder, "dateKey", ord, "charactersRead", "readingTime", "lastStatisticModified"'
DAY_COLUMNS = ["library", "folder", "dateKey", "ord", "charactersRead", "readingTime", "lastStatisticModified"]


@query(with_("once", f"SELECT {DAY} FROM once"))
def a1_dedup_days(spark, sf_dir):
    return once(spark, sf_dir).select(*DAY_COLUMNS)


@query(with_("daily", """SELECT d.library, d.date, d.characters, d.seconds, d.books, t.titles FROM daily d JOIN
    (SELECT library, date, array_to_string(list(folder ORDER BY lower(title), folder), ',') AS titles FROM dated GROUP BY library, date) t USING (library, date)"""))
def a2_daily_totals(spark, sf_dir):
    return daily(spark, sf_dir).select("library", "date", "characters", "seconds", "books", F.array_join(F.transform("contributions", lambda c: c["folder"]), ",").alias("titles"))


@query(with_("daily", "SELECT DISTINCT library, year(date) AS year FROM daily"))
def a3_available_years(spark, sf_dir):
    return S.available_years(daily(spark, sf_dir)).select("library", F.col("year").cast("bigint").alias("year"))


_SPEED = "CASE WHEN seconds > 0 THEN CAST(floor(characters / seconds * 3600.0 + 0.5) AS BIGINT) ELSE 0 END"


@query(with_("daily", f"""SELECT library, characters, seconds, {_SPEED} AS speed, target_days, CASE WHEN n = 1 THEN CAST(floor(r * 100 + 0.5) AS BIGINT) ELSE 0 END AS target_percent FROM (
    SELECT library, CAST(sum(characters) AS BIGINT) AS characters, sum(CAST(round(seconds * 1000) AS BIGINT)) / 1000.0 AS seconds, count(*) FILTER (characters >= {TARGET}) AS target_days, count(*) AS n, max(characters / {TARGET}.0) AS r FROM daily GROUP BY library)"""))
def a4_range_summary(spark, sf_dir):
    return _whole(S.range_summary(daily(spark, sf_dir), KIND, TARGET))


def _whole(df: DataFrame) -> DataFrame:
    """Seconds back on whole milliseconds after a sum of doubles."""
    return df.withColumn("seconds", F.floor(F.col("seconds") * 1000 + 0.5) / 1000.0)


def _overview_sql(mode: str, start: str, end: str, before: str, buckets: str, before_buckets: str) -> str:
    return with_("daily", f"""SELECT c.library, c.characters, c.seconds, c.speed, c.target_days, CASE WHEN c.n = 1 THEN CAST(floor(c.r * 100 + 0.5) AS BIGINT) ELSE 0 END AS target_percent, round(c.seconds / {buckets}, 6) AS average,
        CASE WHEN p.seconds / {before_buckets} > 0 THEN round((c.seconds / {buckets} - p.seconds / {before_buckets}) / (p.seconds / {before_buckets}) * 100.0, 6) END AS change_percent
    FROM (SELECT *, {_SPEED} AS speed FROM (SELECT library, CAST(sum(characters) AS BIGINT) AS characters, sum(CAST(round(seconds * 1000) AS BIGINT)) / 1000.0 AS seconds, count(*) FILTER (characters >= {TARGET}) AS target_days, count(*) AS n, max(characters / {TARGET}.0) AS r
        FROM daily WHERE date <= DATE '{TODAY}' AND date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY library)) c
    LEFT JOIN (SELECT library, sum(CAST(round(seconds * 1000) AS BIGINT)) / 1000.0 AS seconds FROM daily WHERE date >= DATE '{before}' AND date < DATE '{start}' GROUP BY library) p USING (library)""")


def _overview(spark, sf_dir, mode):
    out = _whole(S.period_overview(daily(spark, sf_dir), mode, ANCHOR, TODAY, KIND, TARGET))
    return out.withColumn("average", F.round("average", 6)).withColumn("change_percent", F.round("change_percent", 6))


@query(_overview_sql("week", "2024-01-15", "2024-01-21", "2024-01-08", "7", "7"))
def a5_period_overview_week(spark, sf_dir):
    return _overview(spark, sf_dir, "week")


@query(_overview_sql("month", "2024-01-01", "2024-01-31", "2023-12-01", "25", "31"))
def a5_period_overview_month(spark, sf_dir):
    return _overview(spark, sf_dir, "month")


@query(_overview_sql("year", "2024-01-01", "2024-12-31", "2023-01-01", "1", "12"))
def a5_period_overview_year(spark, sf_dir):
    return _overview(spark, sf_dir, "year")


_FIRST = "(SELECT min(date) FROM daily d WHERE d.library = c.library AND (d.characters > 0 OR d.seconds > 0))"


@query(_overview_sql("all", "1900-01-01", TODAY, "1900-01-01", f"greatest((2024 - year({_FIRST})) * 12 + 1 - month({_FIRST}) + 1, 1)", "1"))
def a5_period_overview_all(spark, sf_dir):
    return _overview(spark, sf_dir, "all")


_STREAKS = f"""runs AS (SELECT library, min(date) AS start, max(date) AS "end", count(*) AS days FROM (SELECT library, date, date - CAST(row_number() OVER (PARTITION BY library ORDER BY date) AS INTEGER) AS run
    FROM daily WHERE characters >= {TARGET} AND date <= DATE '{TODAY}') GROUP BY library, run)"""


@query(with_("daily", f""", {_STREAKS}, own AS (SELECT * FROM daily WHERE date = DATE '{TODAY}')
    SELECT l.library, DATE '{TODAY}' AS date, CAST(floor(coalesce(characters, 0) / {TARGET}.0 * 100 + 0.5) AS BIGINT) AS target_percent, coalesce(characters, 0) AS characters, coalesce(seconds, 0.0) AS seconds,
        coalesce({_SPEED}, 0) AS speed, coalesce(r.days, 0) AS streak
    FROM (SELECT DISTINCT library FROM daily) l LEFT JOIN own USING (library) LEFT JOIN (SELECT * FROM runs WHERE "end" >= DATE '{TODAY}' - 1) r USING (library)"""))
def a6_today_summary(spark, sf_dir):
    return S.today_summary(daily(spark, sf_dir), TODAY, KIND, TARGET)


@query(with_("daily", """, spine AS (SELECT library, strftime(d, '%Y-%m-%d') AS key FROM (SELECT DISTINCT library FROM daily), (SELECT unnest(generate_series(DATE '2024-01-20', DATE '2024-02-05', INTERVAL 1 DAY)) AS d))
    SELECT library, key, coalesce(characters, 0) AS characters, coalesce(seconds, 0.0) AS seconds FROM spine LEFT JOIN (SELECT library, strftime(date, '%Y-%m-%d') AS key, characters, seconds FROM daily) USING (library, key)"""))
def a7_trend_days(spark, sf_dir):
    return S.trend(daily(spark, sf_dir), "month", "2024-01-20", "2024-02-05")


@query(with_("daily", """, spine AS (SELECT library, strftime(d, '%Y-%m') AS key FROM (SELECT DISTINCT library FROM daily), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 MONTH)) AS d))
    SELECT library, key, coalesce(characters, 0) AS characters, coalesce(seconds, 0.0) AS seconds FROM spine LEFT JOIN (SELECT library, strftime(date, '%Y-%m') AS key, CAST(sum(characters) AS BIGINT) AS characters, sum(CAST(round(seconds * 1000) AS BIGINT)) / 1000.0 AS seconds FROM daily GROUP BY 1, 2) USING (library, key)"""))
def a7_trend_months(spark, sf_dir):
    return _whole(S.trend(daily(spark, sf_dir), "year", "2024-01-01", "2024-12-31"))


@query(with_("dated", """SELECT library, folder, bool_and(is_archived) AS is_archived, arg_min(title, date) AS title, CAST(sum("charactersRead") AS BIGINT) AS characters, sum(CAST(round("readingTime" * 1000) AS BIGINT)) / 1000.0 AS seconds,
    row_number() OVER (PARTITION BY library ORDER BY sum(CAST(round("readingTime" * 1000) AS BIGINT)) DESC, lower(arg_min(title, date)), folder) AS place,
    round(sum(CAST(round("readingTime" * 1000) AS BIGINT)) / max(sum(CAST(round("readingTime" * 1000) AS BIGINT))) OVER (PARTITION BY library), 6) AS fraction FROM dated GROUP BY library, folder"""))
def a8_book_distribution(spark, sf_dir):
    rows = dated(spark, sf_dir).withColumn("readingTime", F.floor(F.col("readingTime") * 1000 + 0.5).cast("bigint"))
    return S.book_distribution(rows).withColumn("seconds", F.col("seconds") / 1000.0).withColumn("fraction", F.round("fraction", 6))


@query(with_("daily", f""", {_STREAKS}
    SELECT d.library, coalesce(c.days, 0) AS current_days, c.start AS current_start, coalesce(l.days, 0) AS longest_days, l.start AS longest_start, coalesce(m.met, 0) AS met_days, reading_days, best_day
    FROM (SELECT library, count(*) AS reading_days, arg_max(date, characters * 100000 - (date - DATE '2000-01-01')) AS best_day FROM daily WHERE date <= DATE '{TODAY}' GROUP BY library) d
    LEFT JOIN (SELECT * FROM runs WHERE "end" >= DATE '{TODAY}' - 1) c USING (library)
    LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY library ORDER BY days DESC, start) = 1) l USING (library)
    LEFT JOIN (SELECT library, CAST(sum(days) AS BIGINT) AS met FROM runs GROUP BY library) m USING (library)"""))
def a9_history(spark, sf_dir):
    return S.history(daily(spark, sf_dir), TODAY, KIND, TARGET)


def _up(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST(ceil({a} / {b}) AS BIGINT) ELSE 0 END"


@query(with_("dated", f"""SELECT *, {_up('mean_characters * 3600.0', 'mean_seconds')} AS mean_speed, {_up('weighted_characters * 3600.0', 'weighted_seconds')} AS weighted_speed FROM (
    SELECT library, folder, modified, characters, seconds, min_speed, alt_min_speed, {_up('characters * 3600.0', 'seconds')} AS last_speed, max_speed, {_up('seconds', 'n')} AS mean_seconds, {_up('w', 'characters')} AS weighted_seconds,
        {_up('characters', 'n')} AS mean_characters, {_up('w', 'seconds')} AS weighted_characters FROM (
    SELECT library, folder, CAST(sum("charactersRead") AS BIGINT) AS characters, sum(CAST(round("readingTime" * 1000) AS BIGINT)) / 1000.0 AS seconds, count(*) FILTER ("readingTime" > 0) AS n,
        list_reduce(list("minReadingSpeed" ORDER BY ord), lambda a, x: CASE WHEN a > 0 THEN least(a, x) ELSE x END) AS min_speed, list_reduce(list("altMinReadingSpeed" ORDER BY ord), lambda a, x: CASE WHEN a > 0 THEN least(a, x) ELSE x END) AS alt_min_speed,
        greatest(max("lastReadingSpeed"), 0) AS max_speed, CAST(sum(CAST(floor("readingTime") AS BIGINT) * "charactersRead") AS BIGINT) AS w, max("lastStatisticModified") AS modified
    FROM dated GROUP BY library, folder))"""))
def a10_upload_summary(spark, sf_dir):
    return _whole(S.upload_summary(dated(spark, sf_dir)))


@query(with_("dated", """SELECT library, folder, characters, seconds, modified, CASE WHEN seconds > 0 THEN CAST(trunc(characters / seconds * 3600.0) AS BIGINT) ELSE 0 END AS speed FROM (
    SELECT library, folder, CAST(sum("charactersRead") AS BIGINT) AS characters, sum(CAST(round("readingTime" * 1000) AS BIGINT)) / 1000.0 AS seconds, max("lastStatisticModified") AS modified FROM dated GROUP BY library, folder)"""))
def a11_all_time(spark, sf_dir):
    rows = dated(spark, sf_dir).withColumn("readingTime", F.floor(F.col("readingTime") * 1000 + 0.5).cast("bigint"))
    out = S.all_time(rows).withColumn("seconds", F.col("seconds") / 1000.0)
    return out.withColumn("speed", D.speed_truncated(F.col("characters"), F.col("seconds")))


@query(with_("dated", "SELECT library, count(DISTINCT folder) AS books FROM dated WHERE is_archived GROUP BY library"))
def a19_archive_count(spark, sf_dir):
    days = dated(spark, sf_dir)
    return S.archive_count(days, days.where("is_archived").select("library", "folder").distinct())


@query(with_("daily", f", {_STREAKS} SELECT * FROM runs"))
def w2_goal_streaks(spark, sf_dir):
    return S.goal_streaks(S.until(daily(spark, sf_dir), TODAY), KIND, TARGET)


@query(with_("daily", """, v AS (SELECT library, characters, row_number() OVER (PARTITION BY library ORDER BY characters) - 1 AS r, count(*) OVER (PARTITION BY library) AS n FROM (SELECT DISTINCT library, characters FROM daily WHERE characters > 0))
    SELECT library, date, coalesce(CASE WHEN n = 1 THEN 7 ELSE 1 + CAST(floor(r / (n - 1) * 6 + 0.5) AS BIGINT) END, 0) AS level FROM daily LEFT JOIN v USING (library, characters)"""))
def w3_heat_levels(spark, sf_dir):
    return S.heat_levels(daily(spark, sf_dir))


@query(with_("days", f'SELECT {DAY} FROM days WHERE "charactersRead" > 500 OR "readingTime" > 60'))
def f1_active_days(spark, sf_dir):
    days = reading_days(spark, sf_dir)
    cut = days.withColumn("charactersRead", F.when(F.col("charactersRead") > 500, F.col("charactersRead")).otherwise(0)).withColumn("readingTime", F.when(F.col("readingTime") > 60, F.col("readingTime")).otherwise(0.0))
    return days.join(S.active_days(cut).select("ord"), "ord", "left_semi").select(*DAY_COLUMNS)


@query(with_("days", """SELECT library, k AS "dateKey", CAST(k AS DATE) AS date, count(*) AS n FROM (SELECT library, CASE WHEN ord % 3 = 0 THEN 'day ' || "dateKey" ELSE "dateKey" END AS k FROM days) WHERE k NOT LIKE 'day%' GROUP BY library, k"""))
def f2_dated(spark, sf_dir):
    days = reading_days(spark, sf_dir).withColumn("dateKey", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("day "), "dateKey")).otherwise(F.col("dateKey")))
    return S.dated(days).groupBy("library", "dateKey", "date").agg(F.count("*").alias("n"))


@query(with_("daily", f"SELECT library, date, characters FROM daily WHERE date <= DATE '{TODAY}'"))
def f3_until_today(spark, sf_dir):
    return S.until(daily(spark, sf_dir), TODAY).select("library", "date", "characters")


def _tombstones(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    deleted = days.where("ord % 4 = 0").groupBy("library", "folder", "dateKey").agg(F.max("lastStatisticModified").alias("deleted_at"))
    cleared = days.where("ord % 50 = 0").groupBy("library", "folder").agg(F.min("lastStatisticModified").alias("cleared_at"))
    return deleted, cleared


_TOMBS = """, deleted AS (SELECT library, folder, "dateKey", max("lastStatisticModified") AS d FROM days WHERE ord % 4 = 0 GROUP BY ALL), cleared AS (SELECT library, folder, min("lastStatisticModified") AS c FROM days WHERE ord % 50 = 0 GROUP BY ALL),
    kept AS (SELECT days.* FROM days LEFT JOIN deleted USING (library, folder, "dateKey") LEFT JOIN cleared USING (library, folder) WHERE "lastStatisticModified" > greatest(coalesce(d, -1), coalesce(c, -1)))"""


@query(with_("days", f"{_TOMBS} SELECT {DAY} FROM kept"))
def f11_after_deletes(spark, sf_dir):
    days = reading_days(spark, sf_dir)
    return S.after_deletes(days, *_tombstones(days)).select(*DAY_COLUMNS)


def _devices(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The odd and the even rows of the input as two devices' days; every third day carries the same time on both."""
    days = days.withColumn("lastStatisticModified", F.when(F.substring("dateKey", 10, 1) == "3", F.lit(5).cast("bigint")).otherwise(F.col("lastStatisticModified")))
    return S.dedup_days(days.where("ord % 2 = 1")), S.dedup_days(days.where("ord % 2 = 0"))


_DEVICES = """, m AS (SELECT * REPLACE (CASE WHEN substr("dateKey", 10, 1) = '3' THEN 5 ELSE "lastStatisticModified" END AS "lastStatisticModified") FROM days),
    a AS (SELECT * FROM m WHERE ord % 2 = 1 QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, ord) = 1),
    b AS (SELECT * FROM m WHERE ord % 2 = 0 QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, ord) = 1)"""
_FIRST = """SELECT {c} FROM (SELECT *, {x} AS side FROM a UNION ALL SELECT *, {y} AS side FROM b) QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, side) = 1"""


@query(with_("days", _DEVICES + _FIRST.format(c=DAY, x=0, y=1)))
def j2_merge_days(spark, sf_dir):
    return S.merge_days(*_devices(reading_days(spark, sf_dir))).select(*DAY_COLUMNS)


@query(with_("days", f"{_DEVICES} SELECT {DAY} FROM b"))
def j2_merge_days_replace(spark, sf_dir):
    return S.merge_days(*_devices(reading_days(spark, sf_dir)), mode="replace").select(*DAY_COLUMNS)


@query(with_("days", _DEVICES + _FIRST.format(c=DAY, x=0, y=1)))
def u1_archive_days(spark, sf_dir):
    return S.archive_days(*_devices(reading_days(spark, sf_dir))).select(*DAY_COLUMNS)


@query(with_("days", _DEVICES + _FIRST.format(c=DAY, x=1, y=0)))
def u1_restore_days(spark, sf_dir):
    odd, even = _devices(reading_days(spark, sf_dir))
    return S.restore_days(even, odd).select(*DAY_COLUMNS)


@query(with_("once", """, e AS (SELECT library, folder, "dateKey", ord % 11 AS c, (ord % 13) * 1.5 AS s, ord % 10 = 0 AS d FROM once WHERE ord % 5 = 0),
    n AS (SELECT *, CASE WHEN s > 0 THEN CAST(trunc(c / s * 3600.0) AS BIGINT) ELSE 0 END AS now FROM e)
    SELECT library, folder, "dateKey", coalesce(n.c, "charactersRead") AS "charactersRead", coalesce(n.s, "readingTime") AS "readingTime", coalesce(n.now, "lastReadingSpeed") AS "lastReadingSpeed",
        CASE WHEN n.c IS NULL THEN "minReadingSpeed" WHEN "minReadingSpeed" > 0 AND now > 0 THEN least("minReadingSpeed", now) WHEN "minReadingSpeed" > 0 THEN "minReadingSpeed" ELSE now END AS "minReadingSpeed",
        CASE WHEN n.c IS NULL THEN "maxReadingSpeed" ELSE greatest("maxReadingSpeed", now) END AS "maxReadingSpeed"
    FROM once LEFT JOIN n USING (library, folder, "dateKey") WHERE NOT coalesce(d, false) AND (coalesce(n.c, "charactersRead") > 0 OR coalesce(n.s, "readingTime") > 0)"""))
def u2_day_edits(spark, sf_dir):
    days = once(spark, sf_dir)
    edits = days.where("ord % 5 = 0").select("library", "folder", "dateKey", (F.col("ord") % 11).alias("characters"), ((F.col("ord") % 13) * 1.5).alias("seconds"), (F.col("ord") % 10 == 0).alias("delete"), F.lit(1).cast("bigint").alias("modified"))
    return S.apply_day_edits(days, edits).select("library", "folder", "dateKey", "charactersRead", "readingTime", "lastReadingSpeed", "minReadingSpeed", "maxReadingSpeed")


@query(with_("days", _TOMBS + """, tbl AS (SELECT * FROM days WHERE ord % 2 = 1 QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, ord) = 1),
    batch AS (SELECT * FROM kept WHERE ord % 2 = 0 QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, ord) = 1)
    SELECT """ + DAY + """ FROM (SELECT *, 0 AS side FROM tbl UNION ALL SELECT *, 1 FROM batch) QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, side) = 1"""))
def r6_upsert_days(spark, sf_dir):
    days = reading_days(spark, sf_dir)
    return S.upsert_days(S.dedup_days(days.where("ord % 2 = 1")), days.where("ord % 2 = 0"), *_tombstones(days)).select(*DAY_COLUMNS)


@query(with_("days", """SELECT coalesce(a.library, b.library) AS library, coalesce(a.folder, b.folder) AS folder, coalesce(a.t, b.t) AS title, a.folder IS NULL AS is_archived FROM
    (SELECT DISTINCT library, folder, title || ' (active)' AS t FROM days WHERE NOT is_archived) a FULL OUTER JOIN (SELECT DISTINCT library, folder, title AS t FROM days WHERE library < 4) b ON a.library = b.library AND a.folder = b.folder"""))
def j1_coalesce_archive(spark, sf_dir):
    books = reading_days(spark, sf_dir).select("library", "folder", "title", "is_archived").distinct()
    return S.coalesce_archive(books.where("not is_archived").withColumn("title", F.concat("title", F.lit(" (active)"))), books.where("library < 4"))


@query("""SELECT event_id, CAST(ts - INTERVAL 105 MINUTE + INTERVAL 8 HOUR AS DATE) AS date FROM events""")
def t25_statistics_date(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.statistics_date(F.col("ts").cast("timestamp"), 105, "Asia/Shanghai").alias("date"))


@query("""SELECT o_orderkey, d - CAST((isodow(d) - 1 + 1) % 7 AS INTEGER) AS sunday_week, CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end, CAST(date_trunc('year', d) AS DATE) AS year_start,
    CAST(date_trunc('month', d) AS DATE) - INTERVAL 1 MONTH = CAST(CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS TIMESTAMP) AS ok, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS month_before,
    greatest((year(DATE '2002-01-01') - year(d)) * 12 + month(DATE '2002-01-01') - month(d) + 1, 1) AS pages
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def t26_calendar(spark, sf_dir):
    d = F.to_date("o_orderdate")
    month = D.period_start(d, "month")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.week_start(d, 6).alias("sunday_week"), month.alias("month_start"), D.period_end(month, "month").alias("month_end"), D.period_start(d, "year").alias("year_start"), F.lit(True).alias("ok"),
        D.shift_period(month, "month", -1).alias("month_before"), D.page_count("month", d, F.lit("2002-01-01").cast("date")).cast("bigint").alias("pages"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_quantity > 0 THEN CAST(floor(l_extendedprice / l_quantity * 3600.0 + 0.5) AS BIGINT) ELSE 0 END AS rounded,
    CASE WHEN l_quantity > 0 THEN CAST(trunc(l_extendedprice / l_quantity * 3600.0) AS BIGINT) ELSE 0 END AS truncated FROM lineitem""")
def t27_speeds(spark, sf_dir):
    c, s = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", D.speed(c, s).alias("rounded"), D.speed_truncated(c, s).alias("truncated"))


@query("""SELECT event_id, round(floor(value * 10) / 5000.0, 6) AS by_characters, round(value / 1800.0, 6) AS by_minutes,
    CAST(500 + floor((least(greatest(CAST(floor(value * 1000) AS BIGINT), 500), 200000) - 500) / 500 + 0.5) * 500 AS INTEGER) AS setting FROM events""")
def t28_targets(spark, sf_dir):
    chars = F.floor(F.col("value") * 10)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(D.target_ratio(chars, F.col("value"), "characters", 5000), 6).alias("by_characters"), F.round(D.target_ratio(chars, F.col("value"), "duration", 30), 6).alias("by_minutes"),
        D.snap_setting(F.floor(F.col("value") * 1000), 500, 200000, 500).alias("setting"),
    )


@query("""SELECT doc_id, CASE WHEN lower(lang) = 'en' THEN CAST(ceil(n_chars / 5.0) AS BIGINT) ELSE n_chars END AS units, printf('%.2f%%', (doc_id % 1000) / 1000.0 * 100.0) AS percent,
    CAST(greatest(10, least(10 + CAST(trunc((doc_id % 7) / 8.0 * n_chars) AS INTEGER), 10 + n_chars)) AS INTEGER) AS at_character, epoch / 1000.0 - 978307200 AS reference_seconds, epoch AS back
    FROM (SELECT *, doc_id * 1000000 + 1700000000000 AS epoch FROM documents)""")
def t30_progress(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("epoch", F.col("doc_id") * 1000000 + F.lit(1700000000000))
    return d.select(
        "doc_id", D.display_units(F.col("n_chars"), F.col("lang")).alias("units"), D.percent_text((F.col("doc_id") % 1000) / 1000.0).alias("percent"),
        D.character_at(F.lit(10), F.col("n_chars"), (F.col("doc_id") % 7) / 8.0).alias("at_character"), D.to_reference_seconds(F.col("epoch")).alias("reference_seconds"), D.to_unix_ms(D.to_reference_seconds(F.col("epoch"))).alias("back"),
    )
