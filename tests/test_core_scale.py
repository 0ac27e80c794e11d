"""What the core operators make and read, beside what they return."""

import datetime as dt
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from filingdelta.operators import diagnostics, portfolio, ranking, similarity, stats, variants
from filingdelta.plans import queries
from filingdelta.plans import views as V

DAY = dt.date(2020, 1, 1)


def close(found, wanted):
    assert set(found) == set(wanted)
    for k, row in wanted.items():
        assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(found[k], row, strict=True)), (k, found[k], row)


def test_sums_of_held_names(spark):
    """held_sums against one row for each held name and day: overlapping positions, gaps, missing returns, many blocks."""
    rng = np.random.default_rng(3)
    calendar = spark.createDataFrame([(DAY + dt.timedelta(i), i) for i in range(90)], "date date, day int").cache()
    spans = [(int(d), int(q), f"T{t}", int(a), None if k % 9 == 0 else int(a + n)) for k, (d, q, t, a, n) in enumerate(zip(rng.integers(0, 2, 80), rng.integers(1, 3, 80), rng.integers(0, 12, 80), rng.integers(0, 85, 80), rng.integers(0, 40, 80), strict=True))]
    positions = spark.createDataFrame(spans, "draw int, quantile int, ticker string, entry_day int, exit_day int").cache()
    quotes = [(f"T{t}", DAY + dt.timedelta(d), float(100 + rng.integers(0, 9))) for t in range(11) for d in range(int(rng.integers(0, 30)), 90) if rng.random() < 0.2]
    quoted = portfolio.quoted_returns(spark.createDataFrame(quotes, "ticker string, date date, price double"), calendar)
    assert quoted.count() == len([q for q in quotes if (q[1] - DAY).days < 89 or q[0] in {t for t, d, _ in quotes if d < q[1]}])  # a row a quote
    standing, filled = dict.fromkeys(range(11)), []
    at = {(t, d): p for t, d, p in quotes}
    for i in range(90):
        for t in range(11):
            standing[t] = at.get((f"T{t}", DAY + dt.timedelta(i)), standing[t])
            filled.append((f"T{t}", DAY + dt.timedelta(i), standing[t]))
    dense = portfolio.daily_returns(spark.createDataFrame(filled, "ticker string, date date, price double"), calendar)
    gaps = spark.createDataFrame([(f"T{t}", d, float(rng.normal())) for t in range(12) for d in range(1, 90) if rng.random() < 0.8], "ticker string, day int, ret double")
    for returns, daily in ((quoted, dense), (gaps, gaps)):
        wanted = portfolio.held_days(positions, daily, calendar, ["draw"]).groupBy("draw", "quantile", "day").agg(F.sum("ret"), F.count("*"), F.sum(F.col("stays").cast("int")))
        wanted = {tuple(r)[:3]: tuple(r)[3:] for r in wanted.collect()}
        for width in (7, 128):
            rows = portfolio.held_sums(positions, returns, calendar, ["draw"], width).collect()
            assert len(rows) == len(wanted) > 100
            close({tuple(r)[:3]: tuple(r)[3:] for r in rows}, wanted)


def test_quotes_are_not_filled(spark):
    """Returns of the test tables take a row a quote, not a row a day and ticker."""
    sf = "/root/testdata/sf0.001"
    quotes = V.quotes(spark, sf).count()
    rows = queries.returns_of(spark, sf, queries.calendar_of(spark, sf)).count()
    assert quotes - 10 <= rows <= quotes < queries.q_daily_returns(spark, sf).count()


def test_positions_read_filings_once(spark, tmp_path):
    """The calendar lookups of entry and exit take their months from the calendar: the ranked filings are in the plan once."""
    path = str(tmp_path / "filings")
    spark.createDataFrame([("X", DAY, 1), ("Y", None, 5), ("Z", dt.date(1990, 5, 5), 5), ("W", dt.date(2029, 5, 5), 5)], "ticker string, filing_date date, quantile int").write.parquet(path)
    calendar = spark.createDataFrame([(dt.date(2020, 2, 5) + dt.timedelta(31 * i), i) for i in range(0, 30, 2)], "date date, day int")
    positions = portfolio.build_positions(spark.read.parquet(path), calendar)
    plan = positions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("quantile#") and plan.count("parquet") == 1
    found = {r["ticker"]: (r["entry_day"], r["exit_day"]) for r in positions.collect()}
    assert found == {"X": (0, 12), "Z": (0, 0)}  # months without a trading day go to the next one's


def test_dealt_groups(spark):
    """Extreme groups of dealt scores against dealing and ranking every draw: equal scores at the edges, nulls, a small year."""
    rng = np.random.default_rng(5)
    rows = [(i, f"T{i * 7 % 60:02}", 2000 + (i >= 53) + (i >= 114), DAY, None if i % 17 == 3 else float(rng.integers(0, 9))) for i in range(120)]
    scored = spark.createDataFrame(rows, "id long, ticker string, fiscal_year int, filing_date date, s double").cache()
    key = F.col("id") * 7919 * (F.col("draw") + 3) % 101
    groups, filings = variants.dealt_groups(scored, "s", "id", 23, 5, key, 4)
    found = sorted((r["draw"], r["fiscal_year"], r["ticker"], r["quantile"]) for r in groups.join(filings, ["fiscal_year", "place"]).collect())
    every = scored.filter("s is not null").crossJoin(spark.range(23).select(F.col("id").cast("int").alias("draw")))
    mixed = diagnostics.shuffle_within(every, "s", ["draw", "fiscal_year"], "id", key)
    wanted = ranking.rank_cohort(mixed, "s", 5, ["draw", "fiscal_year"]).filter("quantile in (1, 5)")
    assert found == sorted((r["draw"], r["fiscal_year"], r["ticker"], r["quantile"]) for r in wanted.collect()) and len(found) > 800


def test_exploded_days_are_not_broadcast(spark):
    """Small tables grow when they are exploded, which Spark's sizes leave out: the joins after that are not broadcasts."""
    calendar = spark.createDataFrame([(DAY + dt.timedelta(i), i) for i in range(90)], "date date, day int")
    positions = spark.createDataFrame([(1, "X", 2, None)], "quantile int, ticker string, entry_day int, exit_day int")
    returns = spark.createDataFrame([("X", 5, 0.1)], "ticker string, day int, ret double")
    for made in (portfolio.held_sums(positions, returns, calendar), portfolio.held_days(positions, returns, calendar)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [ticker" in plan and "BroadcastHashJoin [ticker" not in plan


def test_summary_with_a_year_that_does_not_vary(spark, tmp_path):
    """Without trading days before 1995, all returns after the filings of 1993 are 0. corr() in SQL is NaN then, and so are
    the means of all years; SQL counts the year, and NaN as above 0."""
    sf = f"{tmp_path}/sf"
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{sf}/documents.parquet")
    days = F.explode(F.sequence(F.lit(dt.date(1995, 1, 2)), F.lit(dt.date(2001, 12, 3)), F.expr("interval 7 day"))).alias("l_shipdate")
    lines = spark.range(30).select(F.col("id").alias("l_suppkey"), days).withColumn("l_discount", F.pmod(F.hash("l_suppkey", "l_shipdate"), F.lit(10)) / 100.0)
    lines.write.parquet(f"{sf}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    wanted = con.execute(queries.oracle_sql()["rank_summary"]).fetchall()
    found = [tuple(r) for r in queries.q_rank_summary(spark, sf).collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted)) and "nan" in str(found)
    flat = spark.createDataFrame([("a", float(i), 1.0) for i in range(25)], "fiscal_year string, x double, y double")
    assert stats.rank_correlations(flat, "x", "y").first()["rho"] is None
    assert math.isnan(stats.rank_correlations(flat, "x", "y", undefined=float("nan")).first()["rho"])


def test_similarity_takes_every_term(spark, monkeypatch):
    """The query cuts no vocabulary, as its SQL cuts none; the operator keeps its limit for the study."""
    sf = "/root/testdata/sf0.001"
    whole = similarity.compute_similarity
    wanted = sorted(map(tuple, queries.q_similarity_sections(spark, sf).collect()))
    # the limit of the operator at a size at which the test table passes it
    monkeypatch.setattr(whole, "__defaults__", (whole.__defaults__[0], 50))
    assert sorted(map(tuple, queries.q_similarity_sections(spark, sf).collect())) == wanted and len(wanted) > 100
