"""Event time, cumulative abnormal returns, placebo shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingdelta.functions.dates import month_index


def first_day_prices(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows (ticker, month, price): prices of the first trading day of each month; null prices are left out."""
    days = calendar.groupBy(month_index(F.col("date")).alias("month")).agg(F.min("date").alias("date"))
    return prices.filter("price is not null").join(F.broadcast(days), "date").select("ticker", "month", "price")  # a row a month


def event_returns(events: DataFrame, monthly: DataFrame, benchmark: DataFrame, horizon: int = 12, lag: int = 0) -> DataFrame:
    """Rows (ticker, fiscal_year, quantile, event_month, ret, bench, abnormal) of the months 1..horizon after a filing; a
    month is left out if one of its four prices is missing. benchmark: (month, price)."""
    start = events.select("ticker", "fiscal_year", "quantile", (month_index(F.col("filing_date")) + lag).alias("m0"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("event_month"))
    held = monthly.filter("price is not null")
    w, b = Window.partitionBy("ticker").orderBy("month"), Window.orderBy("month")
    stock = held.select("ticker", "month", "price", F.lead("price").over(w).alias("p2"), F.lead("month").over(w).alias("m2")).filter("m2 = month + 1").select("ticker", "month", (F.col("p2") / F.col("price") - 1).alias("ret"))
    base = benchmark.filter("price is not null").select("month", "price", F.lead("price").over(b).alias("p2"), F.lead("month").over(b).alias("m2")).filter("m2 = month + 1").select("month", (F.col("p2") / F.col("price") - 1).alias("bench"))
    moved = start.withColumn("month", F.col("m0") + F.col("event_month"))
    return moved.join(stock, ["ticker", "month"]).join(F.broadcast(base), "month").select("ticker", "fiscal_year", "quantile", "event_month", "ret", "bench", (F.col("ret") - F.col("bench")).alias("abnormal"))


def event_car(panel: DataFrame, n: int = 5) -> DataFrame:
    """Rows (event_month, q_low_car, q_high_car, ls_car, ls_se, n_cohorts, n_filings): means by cohort, summed over months
    within it, then averaged over the cohorts that have both extreme groups; n_filings counts the rows of all groups."""

    def mean(k):
        return F.avg(F.when(F.col("quantile") == k, F.col("abnormal")))

    by = panel.groupBy("fiscal_year", "event_month").agg(mean(1).alias("lo"), mean(n).alias("hi")).dropna()
    w = Window.partitionBy("fiscal_year").orderBy("event_month")
    run = by.select("event_month", F.sum("lo").over(w).alias("lo"), F.sum("hi").over(w).alias("hi"), F.sum(F.col("hi") - F.col("lo")).over(w).alias("ls"))
    filings = panel.groupBy("event_month").agg(F.count("*").alias("n_filings"))
    found = run.groupBy("event_month").agg(F.avg("lo").alias("q_low_car"), F.avg("hi").alias("q_high_car"), F.avg("ls").alias("ls_car"), (F.stddev_samp("ls") / F.sqrt(F.count("*"))).alias("ls_se"), F.count("*").alias("n_cohorts"))
    return found.join(F.broadcast(filings), "event_month")  # a row an event month


def shuffle_within(rows: DataFrame, score: str, cohort: str | list[str], id_col: str, key: Column) -> DataFrame:
    """rows with the scores of a cohort, nulls included, dealt anew: the row at place k by id gets the score at place k by
    key. A draw column that key depends on belongs to the cohort."""
    by = [cohort] if isinstance(cohort, str) else cohort
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    place = rows.select(whole, *[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.row_number().over(Window.partitionBy(*by).orderBy(id_col)).alias("place"))
    dealt = rows.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.row_number().over(Window.partitionBy(*by).orderBy(key, id_col)).alias("place"), F.col(score).alias("dealt_score"))
    joined = place.join(dealt, [*(f"g{i}" for i in range(len(by))), "place"])
    return joined.select(*[F.col("dealt_score").alias(c) if c == score else F.col(f"row.`{c}`").alias(c) for c in rows.columns])


def share_below(rows: DataFrame, column: str, value: float) -> DataFrame:
    return rows.agg(F.avg((F.col(column) < value).cast("double")).alias("share"))


def placebo_summary(draws: DataFrame, actual: float, best: float | None = None) -> DataFrame:
    """One row over placebo draws (sharpe and, if there, t_stat): their number, mean, deviation, 5th and 95th percentile, and
    the shares below the actual and the best variant's Sharpe ratio and with an absolute t above 2."""
    columns = [F.count("*").alias("n_draws"), F.avg("sharpe").alias("sharpe_mean"), F.stddev_samp("sharpe").alias("sharpe_std"), F.expr("percentile(sharpe, 0.05)").alias("sharpe_p05"), F.expr("percentile(sharpe, 0.95)").alias("sharpe_p95"), F.avg((F.col("sharpe") < actual).cast("double")).alias("share_below_actual")]
    if best is not None:
        columns.append(F.avg((F.col("sharpe") < best).cast("double")).alias("share_below_best"))
    if "t_stat" in draws.columns:
        columns.append(F.avg((F.abs("t_stat") > 2).cast("double")).alias("share_abs_t_above_2"))
    return draws.agg(*columns)
