"""Surrogate inputs from the test tables: filings, prices, factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K405").otherwise("10-K/A")
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_custkey").alias("cik"), form.alias("form"), day.alias("report_date"), F.date_add(day, 45).alias("filing_date"), F.col("o_orderkey").alias("accession"))


def text_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    year = (F.lit(1992) + i % 10).cast("int")
    company = F.floor(i / 10).cast("long")
    return table(spark, sf_dir, "documents").select(
        "doc_id", company.alias("ticker"), year.alias("fiscal_year"), F.make_date(year, F.lit(12), F.lit(31)).alias("report_date"),
        F.make_date(year + 1, (1 + company % 4).cast("int"), (10 + company % 15).cast("int")).alias("filing_date"), "text",
    )


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (date) that anything shipped on."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices (ticker, date, price) of each supplier on the days that it shipped. The rows of a ticker are dealt out once, for
    the mean by day and for the windows of a ticker after it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_discount").repartition("ticker")
    return lines.groupBy("ticker", "date").agg(F.round(100 * (1 + F.avg("l_discount")), 6).alias("price"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-filled prices of each supplier on each day that anything shipped, from its own first one on. A price stands
    until the day before the next one, so the days between are exploded: no grid is joined."""
    seen = quotes(spark, sf_dir)
    calendar = trading_days(spark, sf_dir).select("date", F.row_number().over(Window.orderBy("date")).alias("i"))  # a row a day
    until = F.lead("i").over(Window.partitionBy("ticker").orderBy("i"))
    held = seen.join(F.broadcast(calendar), "date").select("ticker", "price", "i", until.alias("next"))
    last = calendar.agg(F.max("i").alias("last"))
    days = held.crossJoin(F.broadcast(last)).select("ticker", "price", F.explode(F.sequence(F.col("i"), F.coalesce(F.col("next") - 1, F.col("last")))).alias("i"))  # one row
    return days.join(F.broadcast(calendar), "i").select("ticker", "date", "price")


def benchmark(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.avg("price").alias("price"))


#: The factors of the surrogate models.
MODELS = {"CAPM": ["mkt"], "FF3": ["mkt", "smb", "hml"], "FF5+MOM": ["mkt", "smb", "hml", "rmw", "cma", "mom"]}


def daily_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"))
    return x.agg(
        ((F.avg("l_discount") - 0.05) / 10).alias("mkt"), ((F.avg("l_tax") - 0.04) / 10).alias("smb"), ((F.avg("l_quantity") - 25) / 5000).alias("hml"),
        ((F.avg("l_linenumber") - 3) / 1000).alias("rmw"), ((F.avg("l_extendedprice") - 38000) / 1e6).alias("cma"), ((F.avg(F.col("l_partkey") % 97) - 48) / 5000).alias("mom"),
        F.lit(0.0001).alias("RF"),
    )


#: Surrogate scores: a multiplier for each of the six similarity columns.
SCORES = {"cos_full": 7919, "jac_full": 104729, "cos_1a": 1299709, "jac_1a": 15485863, "cos_7": 32452843, "jac_7": 49979687}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surrogate filings without text, with all six scores; score is cos_full."""
    made = {k: F.round((F.col("doc_id") * v % 1000003) / F.lit(1000003.0), 9) for k, v in SCORES.items()}
    return text_filings(spark, sf_dir).drop("text").withColumns(made).withColumn("score", F.col("cos_full"))


#: The same in DuckDB's SQL.
ORDER_FILINGS = """f AS (SELECT o_custkey AS cik, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K405' ELSE '10-K/A' END AS form,
  o_orderdate::DATE AS report_date, o_orderdate::DATE + 45 AS filing_date, o_orderkey AS accession FROM orders)"""
TEXT_FILINGS = """ft AS (SELECT doc_id, doc_id // 10 AS ticker, (1992 + doc_id % 10)::INT AS fiscal_year, make_date((1992 + doc_id % 10)::INT, 12, 31) AS report_date,
  make_date((1993 + doc_id % 10)::INT, (1 + (doc_id // 10) % 4)::INT, (10 + (doc_id // 10) % 15)::INT) AS filing_date, text FROM documents)"""
PRICES = """pd AS MATERIALIZED (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem), ps AS (SELECT DISTINCT l_suppkey AS ticker FROM lineitem),
 pa AS MATERIALIZED (SELECT l_suppkey AS ticker, l_shipdate::DATE AS date, round(100 * (1 + avg(l_discount)), 6) AS p FROM lineitem GROUP BY 1, 2),
 prices AS MATERIALIZED (SELECT ps.ticker, pd.date, last_value(pa.p IGNORE NULLS) OVER (PARTITION BY ps.ticker ORDER BY pd.date) AS price
   FROM ps CROSS JOIN pd LEFT JOIN pa ON pa.ticker = ps.ticker AND pa.date = pd.date),
 cal AS MATERIALIZED (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS day FROM pd),
 rets AS MATERIALIZED (SELECT ticker, day, price / lp - 1 AS ret FROM (SELECT p.ticker, c.day, p.price, lag(p.price) OVER (PARTITION BY p.ticker ORDER BY c.day) AS lp FROM prices p JOIN cal c USING (date)) WHERE lp IS NOT NULL AND price IS NOT NULL)"""
SCORED = TEXT_FILINGS + ", sc AS MATERIALIZED (SELECT *, cos_full AS score FROM (SELECT * EXCLUDE (text), " + ", ".join(f"round(((doc_id * {v}) % 1000003) / 1000003.0::DOUBLE, 9) AS {k}" for k, v in SCORES.items()) + " FROM ft))"
GROUP = "(1 + len(list_filter(range(1, {k}), lambda x: r > 1 + (n - 1) * ((x::DOUBLE / {k}::DOUBLE * 100::DOUBLE) / 100::DOUBLE))))::INT"
RANKED = SCORED + f""", rk AS MATERIALIZED (SELECT *, {GROUP.format(k=5)} AS quantile
  FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY score, ticker) AS r, count(*) OVER (PARTITION BY fiscal_year) AS n FROM sc) WHERE n >= 10)"""
TRAILING = """g AS (SELECT a.doc_id, count(*) AS n, sum(CASE WHEN b.score < a.score THEN 1 ELSE 0 END) AS c FROM sc a JOIN sc b ON b.filing_date <= a.filing_date AND b.filing_date > a.filing_date - 365 GROUP BY 1),
 tr AS MATERIALIZED (SELECT doc_id, CASE WHEN n >= 10 THEN least(floor(c::DOUBLE / n * 5) + 1, 5)::INT END AS quantile FROM g)"""
POSITIONS = RANKED + ", " + PRICES + """, po AS (SELECT r.*, (SELECT min(c.day) FROM cal c WHERE c.date >= m1) AS entry_day, (SELECT min(c.date) FROM cal c WHERE c.date >= m1) AS entry,
  (SELECT min(c.day) FROM cal c WHERE c.date >= m2) AS exit_day, (SELECT min(c.date) FROM cal c WHERE c.date >= m2) AS exit
  FROM (SELECT *, (date_trunc('month', filing_date) + INTERVAL 1 MONTH)::DATE AS m1, (date_trunc('month', filing_date) + INTERVAL 13 MONTH)::DATE AS m2 FROM rk) r),
 ps2 AS MATERIALIZED (SELECT * FROM po WHERE entry IS NOT NULL)"""
WEIGHTS = POSITIONS + """, hd AS (SELECT DISTINCT p.quantile, p.ticker, c.day FROM ps2 p JOIN cal c ON c.day > p.entry_day AND c.day <= coalesce(p.exit_day, (SELECT max(day) FROM cal))),
 wt AS MATERIALIZED (SELECT h.quantile, h.day, h.ticker, r.ret, 1.0::DOUBLE / count(*) OVER (PARTITION BY h.quantile, h.day) AS w FROM hd h JOIN rets r USING (ticker, day)),
 qs AS (SELECT quantile, day, avg(ret) AS ret, count(*) AS n FROM wt GROUP BY ALL),
 mv AS (SELECT coalesce(a.quantile, b.quantile) AS quantile, coalesce(a.day, b.day + 1) AS day, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover
   FROM wt a FULL JOIN wt b ON a.quantile = b.quantile AND a.ticker = b.ticker AND a.day = b.day + 1 GROUP BY ALL),
 qd AS MATERIALIZED (SELECT g.quantile, c.day, c.date, qs.ret, coalesce(qs.n, 0) AS n, coalesce(mv.turnover, 0) AS turnover
   FROM (SELECT DISTINCT quantile FROM wt) g CROSS JOIN cal c LEFT JOIN qs ON qs.quantile = g.quantile AND qs.day = c.day LEFT JOIN mv ON mv.quantile = g.quantile AND mv.day = c.day),
 ls AS (SELECT *, CASE WHEN n_long >= 5 AND n_short >= 5 THEN hi - lo END AS ls, CASE WHEN n_long >= 5 AND n_short >= 5 THEN hi - lo - turnover * 0.001 END AS ls_net FROM
   (SELECT day, date, max(ret) FILTER (WHERE quantile = 5) AS hi, max(ret) FILTER (WHERE quantile = 1) AS lo, coalesce(max(n) FILTER (WHERE quantile = 5), 0) AS n_long,
     coalesce(max(n) FILTER (WHERE quantile = 1), 0) AS n_short, sum(turnover) AS turnover FROM qd WHERE quantile IN (1, 5) GROUP BY ALL)),
 mo AS MATERIALIZED (SELECT last_day(date) AS month, product(1 + ls) - 1 AS ls, product(1 + ls_net) - 1 AS ls_net, sum(turnover) AS turnover, arg_max(n_long, day) AS n_long, arg_max(n_short, day) AS n_short
   FROM ls GROUP BY 1 HAVING count(ls) > 0)"""


def portfolio_sql(key: str, cost: float) -> str:
    """CTEs vm (key, month, ls, ls_net) of long-short months of the variants in `vr` (key, ticker, filing_date, lag, quantile,
    top); needs PRICES. Only the extreme groups are held."""
    return f"""vx AS (SELECT *, (date_trunc('month', filing_date) + to_months((1 + lag)::INT))::DATE AS m1, (date_trunc('month', filing_date) + to_months((13 + lag)::INT))::DATE AS m2 FROM vr WHERE quantile IN (1, top)),
 vf AS MATERIALIZED (SELECT m, min(c.day) AS day FROM (SELECT m1 AS m FROM vx UNION SELECT m2 FROM vx) x JOIN cal c ON c.date >= m GROUP BY 1),
 vh AS MATERIALIZED (SELECT DISTINCT {key}, quantile = 1 AS low, ticker, unnest(range(a.day + 1, coalesce(b.day, (SELECT max(day) FROM cal)) + 1)) AS day FROM vx JOIN vf a ON a.m = m1 LEFT JOIN vf b ON b.m = m2),
 vw AS MATERIALIZED (SELECT h.*, r.ret, h.day = 1 + lag(h.day) OVER (PARTITION BY {key}, low, h.ticker ORDER BY h.day) AS stays FROM vh h JOIN rets r USING (ticker, day)),
 vg AS MATERIALIZED (SELECT {key}, low, day, avg(ret) AS ret, count(*) AS n, count(*) FILTER (WHERE stays) AS s FROM vw GROUP BY ALL),
 vp AS (SELECT coalesce(a.{key}, b.{key}) AS {key}, coalesce(a.low, b.low) AS low, coalesce(a.day, b.day + 1) AS day, a.ret, coalesce(a.n, 0) AS n, coalesce(a.s, 0) AS s, coalesce(b.n, 0) AS p
   FROM vg a FULL JOIN vg b ON a.{key} = b.{key} AND a.low = b.low AND a.day = b.day + 1),
 vt AS (SELECT *, CASE WHEN n = 0 OR p = 0 THEN 1 ELSE s * abs(1.0::DOUBLE / n - 1.0::DOUBLE / p) + (n - s) / n::DOUBLE + (p - s) / p::DOUBLE END AS turn FROM vp JOIN cal USING (day)),
 vl AS (SELECT {key}, date, max(ret) FILTER (WHERE NOT low) - max(ret) FILTER (WHERE low) AS ls, sum(turn) AS turn, coalesce(max(n) FILTER (WHERE low), 0) AS a, coalesce(max(n) FILTER (WHERE NOT low), 0) AS b FROM vt GROUP BY ALL),
 vm AS MATERIALIZED (SELECT {key}, last_day(date) AS month, product(1 + ls) - 1 AS ls, product(1 + ls - turn * {cost}::DOUBLE) - 1 AS ls_net FROM vl WHERE a >= 5 AND b >= 5 GROUP BY ALL)"""


def stats_sql(series: str, key: str) -> str:
    """CTE body: evaluate() of a CTE (key, month, ret)."""
    return f"""SELECT {key}, count(*)::BIGINT AS n_months, avg(ret) * 1200 AS mean_ann_pct, stddev_samp(ret) * sqrt(12) * 100 AS vol_ann_pct, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe, avg((ret > 0)::INT) AS hit_rate FROM {series} GROUP BY 1"""


def evaluate_sql(series: str, key: str) -> str:
    """CTEs ending in ev: evaluate() with the HAC t and the drawdown of a CTE (key, month, ret) without nulls."""
    return f"""ea AS MATERIALIZED (SELECT {key}, month, ret, count(*) OVER v AS n, ret - avg(ret) OVER v AS e, avg(ret) OVER v AS m, row_number() OVER (PARTITION BY {key} ORDER BY month) AS i, floor(4 * pow(count(*) OVER v / 100.0, 2.0 / 9.0))::INT AS lg FROM {series} WINDOW v AS (PARTITION BY {key})),
 es AS (SELECT x.{key}, sum(CASE WHEN x.i = y.i THEN 1.0 ELSE 2 * (1 - (x.i - y.i)::DOUBLE / (x.lg + 1)) END * x.e * y.e) AS s, any_value(x.m) AS m, any_value(x.n) AS n, any_value(x.lg) AS lg FROM ea x JOIN ea y ON x.{key} = y.{key} AND x.i - y.i BETWEEN 0 AND x.lg GROUP BY 1),
 ec AS (SELECT {key}, month, product(1 + ret) OVER (PARTITION BY {key} ORDER BY month) AS wealth FROM {series}),
 ed AS (SELECT {key}, min(wealth / pk - 1) * 100 AS md FROM (SELECT *, max(wealth) OVER (PARTITION BY {key} ORDER BY month) AS pk FROM ec) GROUP BY 1),
 ev AS (SELECT q.*, es.lg AS nw_lags, CASE WHEN es.n >= 3 THEN es.m / (sqrt(es.s) / es.n) END AS t_mean_nw, ed.md AS max_drawdown_pct FROM ({stats_sql(series, key)}) q JOIN es USING ({key}) JOIN ed USING ({key}))"""
