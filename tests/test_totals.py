"""Sums and choices that must equal their SQL beyond the size of the test tables."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from readlake.operators import lookup as L
from readlake.operators import statistics as S
from readlake.plans import registered


def test_seconds_are_summed_in_milliseconds(spark):
    rows = [(1, "a", k, 10, x, 5, 5, 5, k) for k, x in enumerate((0.1, 0.2))]
    days = spark.createDataFrame(rows, "library bigint, folder string, ord bigint, charactersRead bigint, readingTime double, minReadingSpeed bigint, altMinReadingSpeed bigint, lastReadingSpeed bigint, lastStatisticModified bigint")
    assert S.upload_summary(days).first()["seconds"] == 0.3


def test_cues_that_start_together_weigh_ids_as_the_sql_does(spark, tmp_path):
    day = datetime.date(1990, 1, 1)
    lines = [(1, 1, 1, 1, 20.0, day), (9_000_000, 1, 1, 1, 19.0, day)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*lines))))), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": [0, 1]}), tmp_path / "part.parquet")
    pq.write_table(pa.table({"o_orderkey": [1], "o_custkey": [2], "o_orderdate": [day]}), tmp_path / "orders.parquet")
    queries, sql = registered()
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute("SELECT id FROM (" + sql["j11_cue_at"] + ")").fetchall()
    assert [tuple(r) for r in queries["j11_cue_at"](spark, str(tmp_path)).select("id").collect()] == want == [(900000000011,)]


def test_term_scan_joins_no_more_terms_than_it_may_return(spark):
    texts = spark.createDataFrame([(k, "ab") for k in range(40)], "text_id bigint, text string")
    terms = spark.createDataFrame([("d", 1, "a", "r", f"{k:03d}") for k in range(200)] + [("d", 1, "ab", "r", "z")], "dict string, dict_order int, expression string, reading string, glossary string")
    out = L.term_scan(texts, terms, spark.createDataFrame([("a", 3)], "expression string, value bigint"), 16, 3)
    got = sorted((r["text_id"], r["place"], r["expression"], r["glossary"]) for r in out.collect())
    assert got == [(t, p, e, g) for t in range(40) for p, e, g in ((1, "ab", "z"), (2, "a", "000"), (3, "a", "001"))]
    limits = out._jdf.queryExecution().optimizedPlan().toString()
    assert limits.count("row_number") > 1 and "WindowGroupLimit [expression" in limits
