"""Calendar lookups, interval positions, equal-weight portfolios, turnover, costs and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingdelta.functions.dates import month_begin
from filingdelta.operators.ranking import rank_filings


def trading_calendar(days: DataFrame) -> DataFrame:
    """Rows (date, day), day counting from 0, of the distinct dates of days. One row a trading day: small at any size. Take
    the dates from a table that has them as they are; a filled price grid would be made for them."""
    return days.select("date").filter("date is not null").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("day"))


def first_trading_day(dates: DataFrame, column: str, calendar: DataFrame, lag: int | Column = 0, name: str = "entry") -> DataFrame:
    """Adds name and name_day: the first trading day on or after the start of the month 1 + lag months after column's;
    null beyond the calendar and for null dates. An as-of join as an equi-join: the answer is worked out once for each month
    of the calendar, and the first month's stands for all before it, so dates are read once."""
    start = month_begin(F.col(column), 1 + lag)
    ends = calendar.agg(F.trunc(F.min("date"), "MM").alias("first_month"), F.trunc(F.max("date"), "MM").alias("last_month"))
    months = ends.select(F.explode(F.sequence("first_month", "last_month", F.expr("interval 1 month"))).alias("at"))
    marks = months.select("at", F.lit(None).cast("date").alias("date"), F.lit(None).cast("int").alias("day"), F.lit(0).alias("kind"))
    marks = marks.unionByName(calendar.select(F.col("date").alias("at"), "date", "day", F.lit(1).alias("kind")))
    ahead = Window.orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.withColumn("next", F.first(F.when(F.col("date").isNotNull(), F.struct("date", "day")), ignorenulls=True).over(ahead))
    found = found.filter("kind = 0").select(F.col("at").alias("month_at"), F.col("next.date").alias("found_date"), F.col("next.day").alias("found_day"))
    whole = dates.select(F.struct(*[F.col(f"`{c}`") for c in dates.columns]).alias("row"), start.alias("month_start")).crossJoin(F.broadcast(ends.select("first_month")))  # one row
    whole = whole.withColumn("month_start", F.when(F.col("month_start").isNotNull(), F.greatest("month_start", "first_month")))
    joined = whole.join(F.broadcast(found), F.col("month_start") == F.col("month_at"), "left")  # a row a month
    return joined.select("row.*", F.col("found_date").alias(name), F.col("found_day").alias(f"{name}_day"))


def build_positions(ranked: DataFrame, calendar: DataFrame, lag: int | Column = 0, holding: int = 12) -> DataFrame:
    """Positions (entry, exit]: without an entry day they go, without an exit day they stay open. lag may be a column."""
    return first_trading_day(first_trading_day(ranked, "filing_date", calendar, lag, "entry"), "filing_date", calendar, lag + holding, "exit").filter("entry is not null")


def daily_returns(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows (ticker, day, ret): the change from the day before in the calendar; none where either price is missing."""
    w = Window.partitionBy("ticker").orderBy("day")
    dated = prices.filter("price is not null").join(F.broadcast(calendar), "date").select("ticker", "day", "price")  # a row a day
    held = dated.select("ticker", "day", "price", F.lag("price").over(w).alias("p"), F.lag("day").over(w).alias("d"))
    return held.filter("d = day - 1").select("ticker", "day", (F.col("price") / F.col("p") - 1).alias("ret"))


def quoted_returns(quotes: DataFrame, calendar: DataFrame) -> DataFrame:
    """The returns of prices (ticker, date, price) that stand until the next one, as rows (ticker, from_day, to_day, ret): with
    a ret the change on that day, without one a run of days that have a return, 0 where no other row names it. A row a quote,
    however many days there are between."""
    w = Window.partitionBy("ticker").orderBy("day")
    dated = quotes.filter("price is not null").join(F.broadcast(calendar), "date").select("ticker", "day", "price")  # a row a day
    dated = dated.select("ticker", "day", "price", F.lag("price").over(w).alias("p")).crossJoin(F.broadcast(calendar.agg(F.max("day").alias("last"))))  # one row
    first = F.col("p").isNull()
    rows = dated.select("ticker", F.when(first, F.col("day") + 1).otherwise(F.col("day")).alias("from_day"), F.when(first, F.col("last")).otherwise(F.col("day")).alias("to_day"), (F.col("price") / F.col("p") - 1).alias("ret"))
    return rows.filter("from_day <= to_day")


def with_runs(returns: DataFrame) -> DataFrame:
    """daily_returns() in the form of quoted_returns()."""
    held = returns.filter("ret is not null").select("ticker", "day", "ret")
    # days of a run less their place are one number
    run = held.select("ticker", "day", (F.col("day") - F.row_number().over(Window.partitionBy("ticker").orderBy("day"))).alias("run"))
    runs = run.groupBy("ticker", "run").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"))
    return held.select("ticker", F.col("day").alias("from_day"), F.col("day").alias("to_day"), "ret").unionByName(runs.select("ticker", "from_day", "to_day", F.lit(None).cast("double").alias("ret")))


def forward_returns(filings: DataFrame, prices: DataFrame, calendar: DataFrame, months: int = 12, name: str = "fwd12") -> DataFrame:
    """Adds name, the return from the first trading day of the month after the filing to that of `months` months later;
    null if a day or price is missing. Two calendar lookups and two equi-joins on (ticker, date)."""
    dated = build_positions(filings.select(F.struct(*[F.col(f"`{c}`") for c in filings.columns]).alias("row"), "ticker", "filing_date"), calendar, 0, months)
    undated = first_trading_day(filings.select(F.struct(*[F.col(f"`{c}`") for c in filings.columns]).alias("row"), "ticker", "filing_date"), "filing_date", calendar).filter("entry is null")
    held = prices.filter("price is not null")
    a = held.select(F.col("ticker").alias("ta"), F.col("date").alias("da"), F.col("price").alias("pa"))
    b = held.select(F.col("ticker").alias("tb"), F.col("date").alias("db"), F.col("price").alias("pb"))
    both = dated.join(a, (F.col("ticker") == F.col("ta")) & (F.col("entry") == F.col("da")), "left").join(b, (F.col("ticker") == F.col("tb")) & (F.col("exit") == F.col("db")), "left")
    none = undated.select("row.*", F.lit(None).cast("double").alias(name))
    return both.select("row.*", (F.col("pb") / F.col("pa") - 1).alias(name)).unionByName(none)


def held_spans(positions: DataFrame, calendar: DataFrame, group: list[str]) -> DataFrame:
    """Rows (group, entry_day, to_day]: the positions of a group that overlap or touch are one."""
    last = calendar.agg(F.max("day").alias("last_day"))
    spans = positions.select(*group, "entry_day", "exit_day").crossJoin(F.broadcast(last))  # one row
    spans = spans.select(*group, "entry_day", F.coalesce("exit_day", "last_day").alias("to_day")).filter("to_day > entry_day")
    by_entry = Window.partitionBy(*group).orderBy("entry_day", "to_day")
    reached = F.max("to_day").over(by_entry.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*group, "entry_day", "to_day", F.when(F.col("entry_day") > reached, 1).otherwise(0).alias("new_span"))
    spans = spans.select(*group, "entry_day", "to_day", F.sum("new_span").over(by_entry).alias("span"))
    return spans.groupBy(*group, "span").agg(F.min("entry_day").alias("entry_day"), F.max("to_day").alias("to_day")).drop("span")


def held_days(positions: DataFrame, returns: DataFrame, calendar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, quantile, ticker, day, ret, stays): each held name with a return that day, and whether it was held with
    one the day before. Overlapping positions of one name are one; the interval join is an explode and an equi-join."""
    group = [*(keys or []), "quantile", "ticker"]
    spans = held_spans(positions, calendar, group)
    days = spans.select(*group, F.explode(F.sequence(F.col("entry_day") + 1, F.col("to_day"))).alias("day"))
    held = days.hint("merge").join(returns.filter("ret is not null").select("ticker", "day", "ret"), ["ticker", "day"])
    return held.select(*group, "day", "ret", F.coalesce(F.lag("day").over(Window.partitionBy(*group).orderBy("day")) == F.col("day") - 1, F.lit(False)).alias("stays"))


def held_sums(positions: DataFrame, returns: DataFrame, calendar: DataFrame, keys: list[str] | None = None, width: int = 128) -> DataFrame:
    """Rows (keys, quantile, day, r, n, s) of each day with a held name: the sum of the returns, the number of names, and how
    many of them were held the day before. returns: daily_returns() or quoted_returns().

    A span of a name meets the changes inside it and the runs that it touches, by blocks of `width` days; it counts from the
    first day to the last that they share, so no row is made for a day without a change."""
    group = [*(keys or []), "quantile"]
    returns = returns if "to_day" in returns.columns else with_runs(returns)

    def block(day: Column) -> Column:
        return F.floor(day / width).cast("int")

    def blocks(first: str, last: str) -> Column:
        return F.explode(F.sequence(block(F.col(first)), block(F.col(last)))).alias("block")

    spans = held_spans(positions, calendar, [*group, "ticker"]).select(*group, "ticker", (F.col("entry_day") + 1).alias("a"), F.col("to_day").alias("b"))
    spans = spans.select(*group, "ticker", "a", "b", blocks("a", "b"))
    moved = returns.select("ticker", "from_day", "to_day", "ret", blocks("from_day", "to_day"))
    start = F.greatest("a", "from_day")
    # the sizes that Spark expects are those before the explodes: nothing here is to be broadcast for them
    met = spans.hint("merge").join(moved, ["ticker", "block"]).filter((F.col("from_day") <= F.col("b")) & (F.col("to_day") >= F.col("a")) & (F.col("block") == block(start)))
    end = F.when(F.col("ret").isNull(), F.least("b", "to_day"))
    sums = met.select(*group, start.alias("day"), end.alias("end"), "ret").groupBy(*group, "day", "end").agg(F.sum("ret").alias("r"), F.count("*").alias("c"))

    def step(day: Column, r: Column, n: Column, s: Column) -> Column:
        return F.struct(day.alias("day"), r.alias("r"), n.alias("n"), s.alias("s"))

    c, none, zero = F.col("c"), F.lit(0.0), F.lit(0).cast("long")
    run = F.array(step(F.col("day"), none, c, zero), step(F.col("day") + 1, none, zero, c), step(F.col("end") + 1, none, -c, -c))
    steps = sums.select(*group, F.explode(F.when(F.col("end").isNull(), F.array(step(F.col("day"), F.col("r"), zero, zero))).otherwise(run)).alias("x"))
    steps = steps.groupBy(*group, F.col("x.day").alias("day")).agg(*[F.sum(f"x.{k}").alias(k) for k in "rns"])
    w = Window.partitionBy(*group).orderBy("day")
    counted = steps.select(*group, "day", "r", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.lead("day").over(w).alias("next")).filter("n > 0")
    days = counted.select(*group, F.col("day").alias("first"), "r", "n", "s", F.explode(F.sequence(F.col("day"), F.col("next") - 1)).alias("day"))
    return days.select(*group, "day", F.when(F.col("day") == F.col("first"), F.col("r")).otherwise(0.0).alias("r"), "n", "s")


def quantile_returns(held: DataFrame, calendar: DataFrame, keys: list[str] | None = None, every_day: bool = False) -> DataFrame:
    """Rows (keys, quantile, day, date, ret, n, turnover): the mean return of the held names, their number, and the sum of
    the absolute changes of weight since the day before, for each day with a name and the day after. With every_day, all
    other days of the calendar too, with a null return and no names.

    Weights are 1/n, so the number of names and of those that stay give the turnover: names are read once, in one sum."""
    group = [*(keys or []), "quantile"]
    one = held.groupBy(*group, "day").agg(F.sum("ret").alias("r"), F.count("*").alias("n"), F.sum(F.col("stays").cast("long")).alias("s"))
    return quantile_turns(one, calendar, keys, every_day)


def quantile_turns(one: DataFrame, calendar: DataFrame, keys: list[str] | None = None, every_day: bool = False) -> DataFrame:
    """quantile_returns() of held_sums(). With every_day the sums are read twice: store them first."""
    group = [*(keys or []), "quantile"]
    zero = F.lit(0).cast("long")
    now = F.struct(F.col("day"), F.col("r"), F.col("n"), F.col("s"), zero.alias("p"))
    after = F.struct((F.col("day") + 1).alias("day"), F.lit(None).cast("double").alias("r"), zero.alias("n"), zero.alias("s"), F.col("n").alias("p"))
    moved = one.select(*group, F.explode(F.array(now, after)).alias("x")).groupBy(*group, F.col("x.day").alias("day")).agg(*[F.sum(f"x.{c}").alias(c) for c in "rnsp"])
    n, s, p = F.col("n"), F.col("s"), F.col("p")
    change = F.when(n == 0, 1.0).when(p == 0, 1.0).otherwise(s * F.abs(1.0 / n - 1.0 / p) + (n - s) / n + (p - s) / p)
    sums = moved.select(*group, "day", (F.col("r") / F.nullif(n, F.lit(0))).alias("ret"), "n", change.alias("turnover"))
    days = F.broadcast(calendar.select("day", "date"))  # a row a day
    if not every_day:
        return sums.join(days, "day").select(*group, "day", "date", "ret", "n", "turnover")
    grid = one.select(*group).distinct().crossJoin(days)
    return grid.join(sums, [*group, "day"], "left").select(*group, "day", "date", "ret", F.coalesce("n", zero).alias("n"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def long_short(quantiles: DataFrame, n: int | Column = 5, cost_bps: float = 0.0, min_names: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, day, date, ls, ls_net, turnover, n_long, n_short): group n less group 1; null unless both have min_names."""
    keys = keys or []

    def pick(k, c):
        return F.max(F.when(F.col("quantile") == k, F.col(c)))

    top = F.lit(n) if isinstance(n, int) else n
    legs = quantiles.filter((F.col("quantile") == 1) | (F.col("quantile") == top))
    wide = legs.groupBy(*keys, "day", "date").agg(pick(top, "ret").alias("hi"), pick(1, "ret").alias("lo"), F.coalesce(pick(top, "n"), F.lit(0)).alias("n_long"), F.coalesce(pick(1, "n"), F.lit(0)).alias("n_short"), F.sum("turnover").alias("turnover"))
    live = (F.col("n_long") >= min_names) & (F.col("n_short") >= min_names)
    ls = F.when(live, F.col("hi") - F.col("lo"))
    return wide.select(*keys, "day", "date", ls.alias("ls"), (ls - F.col("turnover") * F.lit(cost_bps / 1e4)).alias("ls_net"), "turnover", "n_long", "n_short")


def to_monthly(daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Months of a long-short table: returns compounded over valid days (null where there is none, and such months go),
    turnover summed over all days, numbers of names of the last day."""
    keys = keys or []
    month = daily.groupBy(*keys, F.last_day("date").alias("month")).agg((F.product(1 + F.col("ls")) - 1).alias("ls"), (F.product(1 + F.col("ls_net")) - 1).alias("ls_net"), F.sum("turnover").alias("turnover"), F.max_by("n_long", "day").alias("n_long"), F.max_by("n_short", "day").alias("n_short"))
    return month.filter("ls is not null")


def quantile_months(quantiles: DataFrame, months: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, quantile, month, ret): each group's returns compounded over its valid days, for the months of `months`
    (keys, month), those of the long-short portfolio."""
    keys = keys or []
    own = quantiles.groupBy(*keys, "quantile", F.last_day("date").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")).filter("ret is not null")
    return own.join(months.select(*keys, "month"), [*keys, "month"], "left_semi").select(*keys, "quantile", "month", "ret")


def monthly_table(quantiles: DataFrame, months: DataFrame, n: int = 5) -> DataFrame:
    """One row a month: Q1..Qn (null where a group had no day), then ls, ls_net, turnover, n_long, n_short. quantiles:
    quantile_months(), months: to_monthly()."""
    wide = quantiles.groupBy("month").pivot("quantile", list(range(1, n + 1))).agg(F.first("ret"))
    named = wide.select("month", *[F.col(f"`{k}`").alias(f"Q{k}") for k in range(1, n + 1)])
    return months.join(named, "month", "left").select("month", *[f"Q{k}" for k in range(1, n + 1)], "ls", "ls_net", "turnover", "n_long", "n_short")


def between(months: DataFrame, start: str | None = None, end: str | None = None, column: str = "month") -> DataFrame:
    """The rows from one date to another, both included; None is open."""
    keep = F.lit(True)
    for limit, test in ((start, F.col(column) >= F.lit(start).cast("date")), (end, F.col(column) <= F.lit(end).cast("date"))):
        keep = keep & test if limit is not None else keep
    return months.filter(keep)


def run_variant(scored: DataFrame, prices: DataFrame, calendar: DataFrame, score: str, n: int = 5, lag: int = 0, rule: str = "fiscal_year", cost_bps: float = 10.0, min_names: int = 5) -> tuple[DataFrame, DataFrame]:
    """Scores to daily group returns and monthly long-short returns."""
    positions = build_positions(rank_filings(scored, score, n, rule), calendar, lag)
    quantiles = quantile_returns(held_days(positions, daily_returns(prices, calendar), calendar), calendar)
    return quantiles, to_monthly(long_short(quantiles, n, cost_bps, min_names))
