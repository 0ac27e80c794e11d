"""Ranking of scores into groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingdelta.session import ship


def balanced_group(rank: Column, size: Column, n: Column | int) -> Column:
    """Group 1..n of rank 1..size by interpolated, right-closed edges. The order of the arithmetic decides what falls on an
    edge, so it is kept: k / n * 100 / 100."""
    n = F.lit(n) if isinstance(n, int) else n
    edges = F.sequence(F.lit(1), n - 1)
    over = F.filter(edges, lambda k: rank.cast("double") > F.lit(1.0) + (size.cast("double") - 1.0) * ((k.cast("double") / n.cast("double") * 100.0) / 100.0))
    return (F.size(over) + 1).cast("int")


def ranked_in(scored: DataFrame, score: str, cohort: list[str], tie: list[str], block_rows: int = 1_000_000, blocks: int = 64) -> DataFrame:
    """Rows (row, r, n): the whole row, its place by score and tie in its cohort, and the cohort's size; null scores go.

    Cohorts of more than block_rows rows are cut by score into about `blocks` parts that are ranked apart, a part's ranks
    starting after the rows of the parts below it; rows of equal scores are in one part."""
    base = scored.filter(F.col(score).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in scored.columns]).alias("row"), F.struct(*cohort).alias("g"), F.col(score).alias("s"), F.struct(*tie).alias("t"))
    largest = base.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    if largest <= block_rows:
        w = Window.partitionBy("g")
        return base.select("row", F.row_number().over(w.orderBy("s", "t")).alias("r"), F.count("*").over(w).alias("n"))
    shares = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
    sizes = base.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("s", shares, 10_000).alias("cuts"))
    placed = base.join(F.broadcast(sizes), "g").withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("s"))))  # a row a cohort
    below = placed.groupBy("g", "block").agg(F.count("*").alias("m"))
    before = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("g", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    r = F.row_number().over(Window.partitionBy("g", "block").orderBy("s", "t")) + F.col("before")
    return placed.join(F.broadcast(below), ["g", "block"]).select("row", r.cast("int").alias("r"), "n")


def rank_cohort(scored: DataFrame, score: str, n: int | list[int] = 5, cohort: str | list[str] = "fiscal_year", tie: str = "ticker", min_cohort: int | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Adds quantile, the group within each cohort; null scores and cohorts under min_cohort (2n) go. Equal scores go by
    tie. With a list of n, every row is ranked once and grouped for each, which the column n_groups names."""
    many = n if isinstance(n, list) else [n]
    ranked = ranked_in(scored, score, [cohort] if isinstance(cohort, str) else cohort, [tie], block_rows)
    ranked = ranked.select("row", "r", "n", F.explode(F.array(*map(F.lit, many))).alias("k"))
    ranked = ranked.filter(F.col("n") >= (F.lit(min_cohort) if min_cohort else 2 * F.col("k")))
    grouped = ranked.select("row", balanced_group(F.col("r"), F.col("n"), F.col("k")).alias("group_of"), "k")
    return grouped.select("row.*", F.col("group_of").alias("quantile"), *[F.col("k").alias("n_groups")] * isinstance(n, list))


def counted_below(days: int):
    """Rows (d, s, below) of a block (d, s, c): the rows of the block with a smaller score among the `days` days up to d.
    Dates enter and leave a tree of counts by score."""

    def count(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("d", kind="stable")
        d, c = block["d"].to_numpy(), block["c"].to_numpy()
        place = np.unique(block["s"].to_numpy(), return_inverse=True)[1] + 1
        size = int(place.max())
        tree = [0] * (size + 1)

        def add(i: int, by: int) -> None:
            while i <= size:
                tree[i] += by
                i += i & -i

        out = np.zeros(len(block), dtype=np.int64)
        enter = leave = 0
        for k in range(len(block)):
            while enter < len(block) and d[enter] <= d[k]:
                add(int(place[enter]), int(c[enter]))
                enter += 1
            while d[leave] <= d[k] - days:
                add(int(place[leave]), -int(c[leave]))
                leave += 1
            i = int(place[k]) - 1
            while i:
                out[k] += tree[i]
                i -= i & -i
        return pd.DataFrame({"d": block["d"], "s": block["s"], "block": block["block"], "below": out})

    return count


def rank_trailing(scored: DataFrame, score: str, date: str, n: int = 5, days: int = 365, min_cohort: int | None = None, block_rows: int = 4_096) -> DataFrame:
    """Adds quantile, of a score among those of the `days` days up to its date: floor(share below * n) + 1, at most n; null
    where the window is under min_cohort (2n). Null scores and dates go.

    Dates and scores are counted first, one row for each pair, and cut by score into blocks of about block_rows of them. A
    block counts inside itself in n log n; what the blocks below it have in a window comes from running sums by day and
    block, so no two blocks are compared."""
    spark = scored.sparkSession
    ship(spark)
    base = scored.select(F.struct(*[F.col(f"`{c}`") for c in scored.columns]).alias("row"), F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("d"), F.col(score).cast("double").alias("s")).filter("d is not null and s is not null")
    cells = base.groupBy("d", "s").agg(F.count("*").alias("c"))
    blocks = max(1, -(-cells.count() // block_rows))
    cuts = np.array(cells.agg(F.percentile_approx("s", [k / blocks for k in range(1, blocks)], max(10_000, 20 * blocks))).first()[0] if blocks > 1 else [], dtype=float)

    @F.pandas_udf("int")
    def block_of(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, s.to_numpy(), "left").astype(np.int32))

    placed = cells.withColumn("block", block_of("s"))
    inside = placed.groupBy("block").applyInPandas(counted_below(days), "d int, s double, block int, below long")
    # a row for each day that a window starts or ends with and each block, and one more block for the whole
    grid = cells.select(F.explode(F.array("d", F.col("d") - days)).alias("d")).distinct().select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block"))
    counts = placed.groupBy("d", "block").agg(F.sum("c").alias("c"))
    filled = grid.join(counts, ["d", "block"], "left").select("d", "block", F.coalesce("c", F.lit(0)).alias("c"))
    by_day = filled.select("d", "block", F.sum("c").over(Window.partitionBy("block").orderBy("d")).alias("c"))
    lower = by_day.select("d", "block", F.coalesce(F.sum("c").over(Window.partitionBy("d").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower"))
    ends, starts = lower.select("d", "block", F.col("lower").alias("e")), lower.select((F.col("d") + days).alias("d"), "block", F.col("lower").alias("b"))
    window = ends.join(starts, ["d", "block"]).select("d", "block", (F.col("e") - F.col("b")).alias("m"))
    whole = window.filter(F.col("block") == blocks).select("d", F.col("m").alias("n"))
    found = inside.join(window, ["d", "block"]).join(F.broadcast(whole), "d")  # a row a day
    found = found.select("d", "s", (F.col("below") + F.col("m")).alias("below"), "n")
    group = F.least(F.floor(F.col("below").cast("double") / F.col("n") * n) + 1, F.lit(n)).cast("int")
    grouped = base.join(found, ["d", "s"]).select("row", F.when(F.col("n") >= (min_cohort or 2 * n), group).alias("group_of"))
    return grouped.select("row.*", F.col("group_of").alias("quantile"))


def rank_filings(scored: DataFrame, score: str, n: int = 5, rule: str = "fiscal_year", date: str = "filing_date", tie: str = "ticker", min_cohort: int | None = None) -> DataFrame:
    """Ranks by either rule, `fiscal_year` (rank_cohort) or `trailing` (rank_trailing), without the rows that get no group."""
    if rule == "fiscal_year":
        return rank_cohort(scored, score, n, "fiscal_year", tie, min_cohort)
    if rule == "trailing":
        return rank_trailing(scored, score, date, n, min_cohort=min_cohort).filter("quantile is not null")
    raise ValueError(f"no such cohort rule: {rule}")
