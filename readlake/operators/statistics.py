"""Reading statistics: one row per (library, book folder, day) in, roll-ups by library out.

Every operator takes the key columns `by` that tell libraries apart, so all libraries are computed at once and windows are
partitioned by them.  Days carry `ord`, their place in the input, wherever ties are settled by input order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.functions import dates as D

BY = ("library",)



def dedup_days(days: DataFrame, keys: Sequence[str] = ("library", "folder", "dateKey")) -> DataFrame:
    """For each book and day the row modified last; of equals the first in input order."""
    order = Window.partitionBy(*keys).orderBy(F.desc("lastStatisticModified"), F.asc("ord"))
    return days.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def active_days(days: DataFrame) -> DataFrame:
    """Rows with characters or time."""
    return days.where((F.col("charactersRead") > 0) | (F.col("readingTime") > 0))


def dated(days: DataFrame) -> DataFrame:
    """Rows whose key is a date, with that date."""
    return days.withColumn("date", D.valid_date(F.col("dateKey"))).where("date is not null")


def until(days: DataFrame, today: str, column: str = "date") -> DataFrame:
    """Rows not after today."""
    return days.where(F.col(column) <= F.lit(today).cast("date"))


def after_deletes(tracked: DataFrame, deleted_days: DataFrame, cleared_books: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Tracked days newer than the deletion of their day (deleted_at) and than the clearing of their book (cleared_at)."""
    out = tracked.join(deleted_days.select(*keys, "folder", "dateKey", "deleted_at"), [*keys, "folder", "dateKey"], "left")
    out = out.join(cleared_books.select(*keys, "folder", "cleared_at"), [*keys, "folder"], "left")
    gone = F.greatest(F.coalesce("deleted_at", F.lit(-1)), F.coalesce("cleared_at", F.lit(-1)))
    return out.where(F.col("lastStatisticModified") > gone).drop("deleted_at", "cleared_at")


def coalesce_archive(active: DataFrame, archived: DataFrame, keys: Sequence[str] = BY) -> DataFrame:
    """Books of both places: metadata of the active one wins; archived only where there is no active one."""
    a = active.select(*keys, "folder", F.col("title").alias("at"), F.lit(True).alias("a"))
    b = archived.select(*keys, "folder", F.col("title").alias("bt"))
    return a.join(b, [*keys, "folder"], "full_outer").select(*keys, "folder", F.coalesce("at", "bt").alias("title"), F.col("a").isNull().alias("is_archived"))


def daily_totals(days: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Totals of each date, the number of books, and their contributions by lower-case title and folder."""
    contribution = F.struct(F.lower("title").alias("sort"), F.col("folder").alias("folder"), F.col("title").alias("title"), F.col("is_archived").alias("is_archived"), F.col("charactersRead").alias("characters"), F.col("readingTime").alias("seconds"))
    out = days.groupBy(*by, "date").agg(F.sum("charactersRead").alias("characters"), F.sum("readingTime").alias("seconds"), F.count("*").alias("books"), F.array_sort(F.collect_list(contribution)).alias("c"))
    return out.withColumn("contributions", F.transform("c", lambda x: F.struct(x["folder"].alias("folder"), x["title"].alias("title"), x["is_archived"].alias("is_archived"), x["characters"].alias("characters"), x["seconds"].alias("seconds")))).drop("c")


def available_years(daily: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return daily.select(*by, F.year("date").alias("year")).distinct()


def range_summary(daily: DataFrame, kind: str, target: int, by: Sequence[str] = BY) -> DataFrame:
    """Totals, speed, days that met the target, and the target's percentage where there is exactly one day."""
    ratio = D.target_ratio(F.col("characters"), F.col("seconds"), kind, target)
    out = daily.groupBy(*by).agg(F.sum("characters").alias("characters"), F.sum("seconds").alias("seconds"), F.sum((ratio >= 1).cast("bigint")).alias("target_days"), F.count("*").alias("n"), F.max(ratio).alias("r"))
    percent = F.when(F.col("n") == 1, F.floor(F.col("r") * 100 + 0.5)).otherwise(0).cast("bigint")
    return out.select(*by, "characters", "seconds", D.speed(F.col("characters"), F.col("seconds")).alias("speed"), "target_days", percent.alias("target_percent"))


def period_overview(daily: DataFrame, mode: str, anchor: str, today: str, kind: str, target: int, first_day: int = 0, by: Sequence[str] = BY) -> DataFrame:
    """The anchor's period: summary, average seconds per elapsed bucket, and its change against the period before in percent.

    Buckets are days for week and month, months for year and all; 'all' runs from the first activity and has no comparison.
    """
    activity = until(daily, today).where((F.col("characters") > 0) | (F.col("seconds") > 0))
    now, end_day = F.lit(anchor).cast("date"), F.lit(today).cast("date")
    if mode == "all":
        start, end = F.min("date").over(Window.partitionBy(*by)), end_day
        rows = activity.withColumn("start", start).withColumn("end", end).withColumn("which", F.lit(0))
    else:
        first = D.period_start(now, mode, first_day)
        before = D.shift_period(first, mode, -1)
        rows = activity.withColumn("which", F.when((F.col("date") >= first) & (F.col("date") <= D.period_end(first, mode)), 0).when((F.col("date") >= before) & (F.col("date") < first), 1))
        rows = rows.where("which is not null").withColumn("start", F.when(F.col("which") == 0, first).otherwise(before)).withColumn("end", F.when(F.col("which") == 0, D.period_end(first, mode)).otherwise(D.period_end(before, mode)))
    last = F.least(F.col("end"), end_day)
    buckets = F.greatest(D.months_apart(F.col("start"), last) + 1 if mode in ("year", "all") else F.datediff(last, F.col("start")) + 1, F.lit(1))
    sums = range_summary(rows, kind, target, [*by, "which", "start", "end"]).withColumn("average", F.col("seconds") / buckets)
    keyed = [c for c in by]
    current, previous = sums.where("which = 0").drop("which"), sums.where("which = 1").select(*keyed, F.col("average").alias("previous"))
    change = F.when(F.col("previous") > 0, (F.col("average") - F.col("previous")) / F.col("previous") * 100.0)
    return current.join(previous, keyed, "left").withColumn("change_percent", change).drop("previous", "start", "end")


def _met(daily: DataFrame, kind: str, target: int) -> DataFrame:
    return daily.where(D.target_ratio(F.col("characters"), F.col("seconds"), kind, target) >= 1)


def goal_streaks(daily: DataFrame, kind: str, target: int, by: Sequence[str] = BY) -> DataFrame:
    """Runs of consecutive dates that met the target: first and last date and length."""
    order = Window.partitionBy(*by).orderBy("date")
    runs = _met(daily, kind, target).withColumn("run", F.date_sub("date", F.row_number().over(order)))
    return runs.groupBy(*by, "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("run")


def today_summary(daily: DataFrame, today: str, kind: str, target: int, by: Sequence[str] = BY) -> DataFrame:
    """Today's totals and percentage, and the streak that ends today or, if today is not met yet, yesterday."""
    day = F.lit(today).cast("date")
    own = daily.where(F.col("date") == day).select(*by, "characters", "seconds")
    streak = goal_streaks(until(daily, today), kind, target, by).where(F.col("end") >= F.date_sub(day, 1)).select(*by, F.col("days").alias("streak"))
    out = daily.select(*by).distinct().join(own, list(by), "left").join(streak, list(by), "left")
    out = out.fillna(0, ["characters", "streak"]).fillna(0.0, ["seconds"])
    ratio = D.target_ratio(F.col("characters"), F.col("seconds"), kind, target)
    return out.select(*by, day.alias("date"), F.floor(ratio * 100 + 0.5).cast("bigint").alias("target_percent"), "characters", "seconds", D.speed(F.col("characters"), F.col("seconds")).alias("speed"), "streak")


def trend(daily: DataFrame, mode: str, start: str, end: str, by: Sequence[str] = BY) -> DataFrame:
    """Characters and seconds of each day (week, month) or month (year, all) from start to end, zeros filled in."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    monthly = mode in ("year", "all")
    bucket = (lambda c: F.date_format(c, "yyyy-MM")) if monthly else (lambda c: F.date_format(c, "yyyy-MM-dd"))
    step = F.expr("interval 1 month") if monthly else F.expr("interval 1 day")
    spine = daily.select(*by).distinct().withColumn("key", F.explode(F.transform(F.sequence(F.trunc(a, "month") if monthly else a, b, step), bucket)))
    sums = daily.where(F.col("date").between(a, b)).groupBy(*by, bucket(F.col("date")).alias("key")).agg(F.sum("characters").alias("characters"), F.sum("seconds").alias("seconds"))
    return spine.join(sums, [*by, "key"], "left").fillna(0, ["characters"]).fillna(0.0, ["seconds"])


def book_distribution(days: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Totals of each book, whether all its rows are archived, its first title, and its time against the longest book's."""
    rows = active_days(days)
    out = rows.groupBy(*by, "folder").agg(F.every("is_archived").alias("is_archived"), F.min_by("title", F.struct("date", F.lower("title"), "ord")).alias("title"), F.sum("charactersRead").alias("characters"), F.sum("readingTime").alias("seconds"))
    longest = F.max("seconds").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seconds"), F.lower("title"), "folder"))
    return out.withColumn("place", place.cast("bigint")).withColumn("fraction", F.when(longest > 0, F.least(F.greatest(F.col("seconds") / longest, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))


def history(daily: DataFrame, today: str, kind: str, target: int, by: Sequence[str] = BY) -> DataFrame:
    """Current streak (until the day before yesterday breaks it), longest streak (earliest of equals), days met, days read, best day."""
    day = F.lit(today).cast("date")
    activity = until(daily, today).where((F.col("characters") > 0) | (F.col("seconds") > 0))
    streaks = goal_streaks(activity, kind, target, by)
    runs = streaks.groupBy(*by).agg(
        F.max_by(F.struct("days", "start", "end"), F.struct("days", (-F.unix_date("start")).alias("s"))).alias("longest"),
        F.max(F.when(F.col("end") >= F.date_sub(day, 1), F.struct("days", "start", "end"))).alias("current"), F.sum("days").alias("met_days"),
    )
    metric = F.col("characters").cast("double") if kind == "characters" else F.col("seconds")
    read = activity.groupBy(*by).agg(F.count("*").alias("reading_days"), F.max_by("date", F.struct(metric, (-F.unix_date("date")).alias("d"))).alias("best_day"))
    out = read.join(runs, list(by), "left")
    return out.select(*by, F.coalesce("current.days", F.lit(0)).alias("current_days"), F.col("current.start").alias("current_start"), F.coalesce("longest.days", F.lit(0)).alias("longest_days"), F.col("longest.start").alias("longest_start"), F.coalesce("met_days", F.lit(0)).alias("met_days"), "reading_days", "best_day")


def heat_levels(daily: DataFrame, levels: int = 7, by: Sequence[str] = BY) -> DataFrame:
    """Level of each day: the rank of its characters among the library's distinct positive totals, spread over 1 to levels; 0 for none."""
    values = daily.where("characters > 0").select(*by, "characters").distinct()
    rank, n = F.row_number().over(Window.partitionBy(*by).orderBy("characters")) - 1, F.count("*").over(Window.partitionBy(*by))
    level = F.when(n == 1, levels).otherwise(1 + F.floor(rank / (n - 1) * (levels - 1) + 0.5))
    return daily.select(*by, "date", "characters").join(values.select(*by, "characters", level.cast("bigint").alias("level")), [*by, "characters"], "left").fillna(0, ["level"]).select(*by, "date", "level")


def upload_summary(days: DataFrame, by: Sequence[str] = ("library", "folder")) -> DataFrame:
    """Totals and speeds of a book's days, as they stand in the name of its uploaded file.

    The least speeds are a fold in input order in which a zero starts afresh; the greatest is that of the last speeds.  Weights are
    whole seconds times characters; means are over days with time and are rounded up.  Seconds are summed in whole milliseconds: what
    is rounded up must not depend on the order of a sum.
    """
    row = F.struct("ord", F.col("minReadingSpeed").cast("bigint").alias("least"), F.col("altMinReadingSpeed").cast("bigint").alias("alt"))
    fold = lambda name: F.aggregate("rows", F.lit(0).cast("bigint"), lambda acc, x: F.when(acc > 0, F.least(acc, x[name])).otherwise(x[name]))
    out = days.groupBy(*by).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.sum("charactersRead").alias("characters"), (F.sum(F.round(F.col("readingTime") * 1000).cast("bigint")) / 1000.0).alias("seconds"), F.greatest(F.max("lastReadingSpeed"), F.lit(0)).cast("bigint").alias("max_speed"),
        F.sum((F.col("readingTime") > 0).cast("bigint")).alias("n"), F.sum(F.col("readingTime").cast("bigint") * F.col("charactersRead")).alias("w"), F.max("lastStatisticModified").alias("modified"),
    )
    up = lambda a, b: F.when(F.col(b) > 0, F.ceil(a / F.col(b))).otherwise(0).cast("bigint")
    out = out.select(
        *by, "modified", "characters", "seconds", fold("least").alias("min_speed"), fold("alt").alias("alt_min_speed"), up(F.col("characters") * 3600.0, "seconds").alias("last_speed"), "max_speed",
        up(F.col("seconds"), "n").alias("mean_seconds"), up(F.col("w"), "characters").alias("weighted_seconds"), up(F.col("characters"), "n").alias("mean_characters"), up(F.col("w"), "seconds").alias("weighted_characters"),
    )
    return out.withColumn("mean_speed", up(F.col("mean_characters") * 3600.0, "mean_seconds")).withColumn("weighted_speed", up(F.col("weighted_characters") * 3600.0, "weighted_seconds"))


def all_time(days: DataFrame, by: Sequence[str] = ("library", "folder")) -> DataFrame:
    """Totals of a book over all days and its truncated speed."""
    out = days.groupBy(*by).agg(F.sum("charactersRead").alias("characters"), F.sum("readingTime").alias("seconds"), F.max("lastStatisticModified").alias("modified"))
    return out.withColumn("speed", D.speed_truncated(F.col("characters"), F.col("seconds")))


def archive_days(archived: DataFrame, active: DataFrame, keys: Sequence[str] = ("library", "folder", "dateKey")) -> DataFrame:
    """Days after archiving: both sets as one, the archived one first where they tie."""
    return dedup_days(archived.withColumn("ord", F.struct(F.lit(0), "ord")).unionByName(active.withColumn("ord", F.struct(F.lit(1), "ord"))), keys).withColumn("ord", F.col("ord.ord"))


def restore_days(active: DataFrame, archived: DataFrame, keys: Sequence[str] = ("library", "folder", "dateKey")) -> DataFrame:
    """Days after restoring: the active set first where they tie."""
    return archive_days(active, archived, keys)


def apply_day_edits(days: DataFrame, edits: DataFrame, keys: Sequence[str] = ("library", "folder", "dateKey")) -> DataFrame:
    """Days with edits (characters, seconds, delete, modified) applied: speeds recomputed, deleted and inactive rows dropped."""
    e = edits.select(*keys, F.col("characters").alias("ec"), F.col("seconds").alias("es"), F.col("delete").alias("ed"), F.col("modified").alias("em"))
    out = days.join(e, list(keys), "left").where(~F.coalesce("ed", F.lit(False)))
    edited = F.col("ec").isNotNull()
    now, least, most = D.updated_speeds(F.col("ec"), F.col("es"), F.col("minReadingSpeed"), F.col("maxReadingSpeed"))
    for name, value in (("lastReadingSpeed", now), ("minReadingSpeed", least), ("maxReadingSpeed", most), ("charactersRead", F.col("ec")), ("readingTime", F.col("es")), ("lastStatisticModified", F.col("em"))):
        out = out.withColumn(name, F.when(edited, value).otherwise(F.col(name)))
    return active_days(out).drop("ec", "es", "ed", "em")


def archive_count(days: DataFrame, archived: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Archived books with any activity."""
    return archived.join(active_days(days), [*by, "folder"], "left_semi").groupBy(*by).agg(F.countDistinct("folder").alias("books"))


def merge_days(first: DataFrame, second: DataFrame, mode: str = "merge", keys: Sequence[str] = ("library", "folder", "dateKey")) -> DataFrame:
    """Two devices' days as one: the newer row of each day, the first argument's where equal; 'replace' takes the second as it is."""
    if mode == "replace":
        return second
    columns = [c for c in first.columns if c not in keys]
    a, b = (df.select(*keys, F.struct(*columns).alias(n)) for df, n in ((first, "a"), (second, "b")))
    take_b = F.col("a").isNull() | (F.col("b.lastStatisticModified") > F.col("a.lastStatisticModified"))
    return a.join(b, list(keys), "full_outer").withColumn("r", F.when(F.coalesce(take_b, F.lit(False)), F.col("b")).otherwise(F.col("a"))).select(*keys, "r.*")


def upsert_days(table: DataFrame, batch: DataFrame, deleted_days: DataFrame, cleared_books: DataFrame, keys: Sequence[str] = ("library", "folder", "dateKey")) -> DataFrame:
    """The table after a batch of tracked days: deletions hold against queued writes, and older rows never replace newer ones."""
    kept = after_deletes(batch, deleted_days, cleared_books, keys[:-2])
    return merge_days(table, dedup_days(kept, keys), keys=keys)
