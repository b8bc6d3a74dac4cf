"""Domain tables derived from the driver's tables: as DataFrames, and as the same tables in DuckDB SQL (CTES) for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of readers (as book folders of seven libraries), one row for each event type, so several for each day."""
    e = table(spark, sf_dir, "events").withColumn("dateKey", F.date_format("ts", "yyyy-MM-dd")).withColumn("chars", F.floor(F.col("value") * 10).cast("bigint")).withColumn("ms", F.floor(F.col("value") * 1000).cast("bigint"))
    out = e.groupBy("user_id", "dateKey", "event_type").agg(F.sum("chars").alias("charactersRead"), (F.sum("ms") / 1000.0).alias("readingTime"), F.min("chars").alias("minReadingSpeed"), F.max("chars").alias("maxReadingSpeed"), F.count("*").alias("altMinReadingSpeed"), F.max(F.expr("unix_millis(cast(ts as timestamp))")).alias("lastStatisticModified"), F.min("event_id").alias("ord"))
    return out.select(
        (F.col("user_id") % 7).alias("library"), F.concat(F.lit("reader-"), F.col("user_id").cast("string")).alias("folder"), (F.col("user_id") % 5 == 0).alias("is_archived"), "ord", F.concat(F.lit("Book "), F.col("user_id").cast("string")).alias("title"),
        "dateKey", "charactersRead", "readingTime", "minReadingSpeed", "altMinReadingSpeed", ((F.col("minReadingSpeed") + F.col("maxReadingSpeed")) / 2).cast("bigint").alias("lastReadingSpeed"), "maxReadingSpeed", "lastStatisticModified",
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page turns of readers: library, reader, book, ts, seconds since 1970, event kind, character position."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "signup", "start").otherwise("update")
    return e.select(F.col("user_id").alias("reader"), (F.col("event_id") % 2).alias("book"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.floor(F.col("value") * 10).cast("bigint").alias("position"))


CTES = {
    "days": """days AS (SELECT user_id % 7 AS library, 'reader-' || user_id AS folder, user_id % 5 = 0 AS is_archived, min(event_id) AS ord, 'Book ' || user_id AS title,
        strftime(ts, '%Y-%m-%d') AS "dateKey", CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS "charactersRead", sum(CAST(floor(value * 1000) AS BIGINT)) / 1000.0 AS "readingTime",
        min(CAST(floor(value * 10) AS BIGINT)) AS "minReadingSpeed", count(*) AS "altMinReadingSpeed", (min(CAST(floor(value * 10) AS BIGINT)) + max(CAST(floor(value * 10) AS BIGINT))) // 2 AS "lastReadingSpeed",
        max(CAST(floor(value * 10) AS BIGINT)) AS "maxReadingSpeed", max(epoch_us(ts) // 1000) AS "lastStatisticModified" FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'), event_type)""",
    "once": """once AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY library, folder, "dateKey" ORDER BY "lastStatisticModified" DESC, ord) = 1)""",
    "dated": """dated AS (SELECT *, CAST("dateKey" AS DATE) AS date FROM once WHERE "charactersRead" > 0 OR "readingTime" > 0)""",
    "daily": """daily AS (SELECT library, date, CAST(sum("charactersRead") AS BIGINT) AS characters, sum(CAST(round("readingTime" * 1000) AS BIGINT)) / 1000.0 AS seconds, count(*) AS books FROM dated GROUP BY library, date)""",
}


def with_(names: str, body: str) -> str:
    """Body under the named tables, with all that they need before them."""
    order = list(CTES)
    need = {"once": ["days"], "dated": ["days", "once"], "daily": ["days", "once", "dated"]}
    wanted = {x for n in names.split() for x in [*need.get(n, []), n]}
    return "WITH " + ",\n".join(CTES[n] for n in order if n in wanted) + "\n" + body
