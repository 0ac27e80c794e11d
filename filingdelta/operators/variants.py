"""Many variants of the strategy in one job: the grid of scores, groups and lags, and shuffled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingdelta.operators import portfolio, ranking
from filingdelta.storage import materialize

#: The grid.
MEASURES, SECTIONS, GROUPS, LAGS = ("cos", "jac"), ("full", "1a", "7"), (3, 5, 10), (0, 1, 2)
SCORES = [f"{m}_{s}" for m in MEASURES for s in SECTIONS]


def variant_months(scored: DataFrame, returns: DataFrame, calendar: DataFrame, scores: list[str] | None = None, groups: tuple[int, ...] = GROUPS, lags: tuple[int, ...] = LAGS, cost_bps: float = 10.0, min_names: int = 5) -> DataFrame:
    """Rows (variant, month, ls, ls_net, turnover, n_long, n_short) of every score, number of groups and lag, the variant
    named as in cos_full|q5|lag0. A score is ranked once for all numbers of groups, and only the extreme groups are held."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in scores or SCORES])
    long = scored.select("ticker", "fiscal_year", "filing_date", F.explode(each).alias("x")).select("ticker", "fiscal_year", "filing_date", "x.name", "x.value")
    top = ranking.rank_cohort(long, "value", list(groups), ["name", "fiscal_year"]).filter("quantile = 1 or quantile = n_groups")
    # a variant is its place among these names until its months are made
    named = [f"{c}|q{k}|lag{lag}" for c in scores or SCORES for k in groups for lag in lags]
    lagged = top.withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    place = F.array_position(F.array(*map(F.lit, named)), F.format_string("%s|q%d|lag%d", "name", "n_groups", "lag")).cast("int")
    positions = portfolio.build_positions(lagged.select("ticker", "filing_date", "lag", place.alias("variant"), F.when(F.col("quantile") == 1, 1).otherwise(2).alias("quantile")), calendar, F.col("lag"))
    quantiles = portfolio.quantile_turns(portfolio.held_sums(positions, returns, calendar, ["variant"]), calendar, ["variant"])
    months = portfolio.to_monthly(portfolio.long_short(quantiles, 2, cost_bps, min_names, ["variant"]), ["variant"])
    return months.withColumn("variant", F.element_at(F.array(*map(F.lit, named)), F.col("variant")))


def dealt_groups(scored: DataFrame, score: str, id_col: str, draws: int, n: int, key: Column, per_block: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows (fiscal_year, place, draw, quantile) of the extreme groups, 1 and n, when the scores of a fiscal year are dealt
    anew `draws` times: the score at a place by key goes to the filing at that place by id, and groups are those of
    rank_cohort. Second result: rows (fiscal_year, place, ticker, filing_date), a row a filing.

    A score keeps its rank whoever gets it, so scores are ranked once and only their places are drawn; the tie of equal
    scores matters where their ranks are of two groups, and is settled by the receivers' tickers. Filings are dealt out once
    for per_block draws."""
    year, value = Window.partitionBy("fiscal_year"), Window.partitionBy("fiscal_year", score)
    own = scored.filter(F.col(score).isNotNull()).select(id_col, "ticker", "fiscal_year", "filing_date", score)
    own = own.select("*", F.row_number().over(year.orderBy(id_col)).alias("place"), F.rank().over(year.orderBy(score)).alias("first"), F.count("*").over(value).alias("same"), F.count("*").over(year).alias("size"))
    own = own.withColumns({"low": ranking.balanced_group(F.col("first"), F.col("size"), n), "high": ranking.balanced_group(F.col("first") + F.col("same") - 1, F.col("size"), n)})
    own = materialize(own.filter(F.col("size") >= 2 * n), "filings")  # a row a filing
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // per_block))).alias("block")
    dealt = own.select(id_col, "fiscal_year", "first", "size", "low", "high", blocks).repartition("fiscal_year", "block")
    dealt = dealt.select("*", F.explode(F.sequence(F.col("block") * per_block, F.least((F.col("block") + 1) * per_block, F.lit(draws)) - 1)).alias("draw"))
    dealt = dealt.select("*", F.row_number().over(Window.partitionBy("fiscal_year", "block", "draw").orderBy(key, id_col)).alias("place")).filter((F.col("low") == 1) | (F.col("high") == n))
    filings = own.select("fiscal_year", "place", "ticker", "filing_date")
    found = dealt.filter("low = high").select("fiscal_year", "place", "draw", F.col("low").alias("quantile"))
    if not own.filter("low <> high").isEmpty():
        tied = dealt.filter("low <> high").hint("merge").join(filings.select("fiscal_year", "place", "ticker"), ["fiscal_year", "place"])
        rank = F.col("first") + F.row_number().over(Window.partitionBy("fiscal_year", "draw", "first").orderBy("ticker")) - 1
        tied = tied.select("fiscal_year", "place", "draw", ranking.balanced_group(rank, F.col("size"), n).alias("quantile"))
        found = found.unionByName(tied.filter((F.col("quantile") == 1) | (F.col("quantile") == n)))
    return found, filings


def placebo_months(scored: DataFrame, score: str, id_col: str, returns: DataFrame, calendar: DataFrame, draws: int = 200, n: int = 5, key: Column | None = None, min_names: int = 5) -> DataFrame:
    """Rows (draw, month, ls, ...) of the strategy on scores shuffled within each fiscal year, `draws` times. key orders the
    scores that are dealt out and may use the column draw; by default a hash of draw and id."""
    groups, filings = dealt_groups(scored, score, id_col, draws, n, F.xxhash64("draw", id_col) if key is None else key)
    held = portfolio.build_positions(filings, calendar).select("fiscal_year", "place", "ticker", "entry_day", "exit_day")
    positions = groups.hint("merge").join(held, ["fiscal_year", "place"]).drop("fiscal_year", "place")
    sums = portfolio.held_sums(positions, returns, calendar, ["draw"])
    return portfolio.to_monthly(portfolio.long_short(portfolio.quantile_turns(sums, calendar, ["draw"]), n, 0.0, min_names, ["draw"]), ["draw"])
