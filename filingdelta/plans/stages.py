"""The whole study as stages: each stores its table under a folder and is read from there the next time.

    python -m filingdelta.plans.stages --index I --sections S --prices P --factors F --out O [--refresh] [--placebo-draws N]

index, sections, prices and factors are Parquet tables: index as similarity.compute_similarity takes it, sections
(accession, section, text), prices (ticker, date, price; the benchmark among the tickers), factors (date, the factors, RF).
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingdelta.operators import diagnostics, overfit, portfolio, ranking, similarity, stats, variants
from filingdelta.sources import sinks
from filingdelta.sources.readers import cached_stage, symbol

#: The main specification.
SCORE, GROUPS, COST_BPS, BENCHMARK = "cos_full", 5, 10.0, "SPY"
MAIN_MODEL = "FF5+MOM"


@dataclass
class Study:
    """The inputs, where results go, and what may be smaller in a trial run."""

    index: DataFrame
    sections: DataFrame
    prices: DataFrame
    factors: DataFrame
    out: str
    refresh: bool = False
    draws: int = 200
    min_names: int = 5
    min_bytes: int = similarity.MIN_BYTES
    split: str = "2016-12-31"
    benchmark: str = BENCHMARK
    models: dict[str, list[str]] | None = None

    def __post_init__(self):
        self.spark: SparkSession = self.index.sparkSession
        self.models = self.models or stats.FACTOR_MODELS
        self.calendar = portfolio.trading_calendar(self.prices)
        self.returns = portfolio.daily_returns(self.prices, self.calendar)

    def stage(self, name: str, make) -> DataFrame:
        return cached_stage(self.spark, f"{self.out}/{name}", make, self.refresh)

    def similarity(self) -> DataFrame:
        found = self.stage("similarity", lambda: similarity.compute_similarity(self.index, self.sections, self.min_bytes))
        return found.withColumn("ticker", symbol(F.col("ticker"))) if dict(found.dtypes)["ticker"] == "string" else found

    def monthly_factors(self) -> DataFrame:
        columns = sorted({c for m in self.models.values() for c in m} | {"RF"})
        return self.stage("factors_monthly", lambda: stats.monthly_factors(self.factors, columns))

    def months_of(self, rule: str) -> tuple[DataFrame, DataFrame]:
        quantiles = self.stage(f"quantiles_{rule}", lambda: portfolio.run_variant(self.similarity(), self.prices, self.calendar, SCORE, GROUPS, 0, rule, COST_BPS, self.min_names)[0])
        return quantiles, self.stage(f"months_{rule}", lambda: portfolio.to_monthly(portfolio.long_short(quantiles, GROUPS, COST_BPS, self.min_names)))

    def portfolio(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The long-short months, the evaluation of each portfolio, the alphas of LS and LS_net."""
        quantiles, months = self.months_of("fiscal_year")
        series = self.stage("series", lambda: stats.portfolio_series(portfolio.quantile_months(quantiles, months), months, self.monthly_factors()))
        table, found = stats.evaluate_portfolio(series, self.monthly_factors(), self.models)
        return months, self.stage("quantile_table", lambda: table), self.stage("alphas", lambda: found)

    def trials(self) -> tuple[DataFrame, DataFrame]:
        """The statistics of the 54 variants and their months."""
        months = self.stage("trials_monthly", lambda: variants.variant_months(self.similarity(), self.returns, self.calendar, cost_bps=COST_BPS, min_names=self.min_names))
        own = {MAIN_MODEL: self.models[MAIN_MODEL]}

        def make() -> DataFrame:
            found = stats.evaluate(months, ["variant"], "month", "ls")
            alpha = stats.alphas(months, self.monthly_factors(), ["variant"], "month", "ls", own).select("variant", F.col("alpha_ann_pct").alias("alpha"), F.col("t_stat").alias("t_alpha"))
            net = stats.summary(months, ["variant"], "ls_net").select("variant", F.col("sharpe").alias("sharpe_net"))
            common = stats.summary(overfit.common_months(months), ["variant"], "ls").select("variant", F.col("sharpe").alias("sharpe_common_sample"))
            return found.join(alpha, "variant", "left").join(net, "variant", "left").join(common, "variant", "left")

        return self.stage("trials", make), months

    def robustness(self) -> DataFrame:
        main, trailing = self.months_of("fiscal_year")[1], self.months_of("trailing")[1]
        parts = [("main", main), ("trailing", trailing), (f"main, to {self.split}", portfolio.between(main, end=self.split)), (f"main, after {self.split}", main.filter(F.col("month") > F.lit(self.split).cast("date")))]

        def make() -> DataFrame:
            rows = [m.select(F.lit(name).alias("specification"), "month", F.col("ls").alias("ret")) for name, m in parts]
            series = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
            alpha = stats.alphas(series, self.monthly_factors(), ["specification"], "month", models={MAIN_MODEL: self.models[MAIN_MODEL]})
            return stats.evaluate(series, ["specification"], "month").join(alpha.select("specification", F.col("alpha_ann_pct").alias("alpha"), F.col("t_stat").alias("t_alpha")), "specification", "left")

        return self.stage("robustness", make)

    def rank_correlations(self) -> DataFrame:
        def make() -> DataFrame:
            rows = portfolio.forward_returns(self.similarity(), self.prices, self.calendar)
            each = F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in variants.SCORES])
            long = rows.select("fiscal_year", "fwd12", F.explode(each).alias("x")).select("fiscal_year", "fwd12", "x.score", "x.value")
            return stats.rank_summary(stats.rank_correlations(long, "value", "fwd12", ["score", "fiscal_year"]), ["score"])

        return self.stage("rank_correlations", make)

    def event_time(self) -> DataFrame:
        def make() -> DataFrame:
            first = diagnostics.first_day_prices(self.prices, self.calendar)
            base = first.filter(F.col("ticker") == F.lit(self.benchmark)).select("month", "price")
            return diagnostics.event_car(diagnostics.event_returns(ranking.rank_filings(self.similarity(), SCORE, GROUPS), first, base), GROUPS)

        return self.stage("event_time", make)

    def placebo(self) -> DataFrame:
        months = self.stage("placebo_monthly", lambda: variants.placebo_months(self.similarity(), SCORE, "accession", self.returns, self.calendar, self.draws, GROUPS, min_names=self.min_names))

        def make() -> DataFrame:
            alpha = stats.alphas(months, self.monthly_factors(), ["draw"], "month", "ls", {MAIN_MODEL: self.models[MAIN_MODEL]}).select("draw", F.col("alpha_ann_pct").alias("alpha"), "t_stat")
            return stats.summary(months, ["draw"], "ls").join(alpha, "draw", "left")

        return self.stage("placebo", make)

    def summary(self, report: dict) -> dict:
        """The sample's counts and dates, the benchmark's Sharpe ratio, the placebo's place and the event-time result."""
        found = sinks.counts_of(self.similarity(), ["cos_1a", "cos_7"]).first()
        months, table, _ = self.portfolio()
        ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b"), F.count("*").alias("n"), F.avg("n_long").alias("leg"), F.least(F.min("n_long"), F.min("n_short")).alias("least"), (F.avg("turnover") * 12).alias("turnover")).first()
        market = self.returns.filter(F.col("ticker") == F.lit(self.benchmark)).join(F.broadcast(self.calendar), "day")
        market = market.groupBy(F.last_day("date").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")).join(months.select("month"), "month", "left_semi")
        excess = market.join(self.monthly_factors(), "month").select("month", (F.col("ret") - F.col("RF")).alias("ret"))
        actual = table.filter("portfolio = 'LS'").first()
        draws = diagnostics.placebo_summary(self.placebo(), actual["sharpe"] if actual and actual["sharpe"] is not None else float("nan"), report["best_sharpe"]).first().asDict()
        last = self.event_time().orderBy(F.desc("event_month")).first()
        market_row = stats.summary(excess, [], "ret").first()
        index = self.index.agg(F.count_distinct("ticker").alias("c"), F.count("*").alias("n")).first()
        return {
            "n_companies": index["c"], "n_filings": index["n"], "n_pairs": found["n"], "n_pairs_with_1a": found["n_cos_1a"], "n_pairs_with_7": found["n_cos_7"],
            "sample_start": str(ends["a"]), "sample_end": str(ends["b"]), "n_months": ends["n"], "cost_bps": COST_BPS, "leg_size": ends["leg"], "leg_min": ends["least"], "turnover": ends["turnover"],
            "benchmark_sharpe": market_row["sharpe"] if market_row else None, "event_time_ls_car": last["ls_car"] if last else None,
            "event_time_ls_t": last["ls_car"] / last["ls_se"] if last and last["ls_se"] else None,
        } | {f"placebo_{k}": v for k, v in draws.items()}

    def run(self) -> dict:
        """All stages; the small tables as CSV too, the report on overfitting and the summary as JSON, the LaTeX."""
        months, table, alphas = self.portfolio()
        trials, trial_months = self.trials()
        report = overfit.report(trial_months)
        quantiles = self.months_of("fiscal_year")[0]
        small = {"portfolio_monthly": portfolio.monthly_table(portfolio.quantile_months(quantiles, months), months, GROUPS), "quantile_table": table, "alphas": alphas.drop("betas"), "trials": trials, "robustness": self.robustness(), "rank_correlations": self.rank_correlations(), "event_time": self.event_time(), "placebo": self.placebo()}
        for name, rows in small.items():
            sinks.write_csv(rows, f"{self.out}/csv/{name}")
        summary = self.summary(report)
        text = {"overfitting.json": sinks.as_json(report), "summary.json": sinks.as_json(summary), "numbers.tex": numbers(summary, report, table, alphas, trials), "main_ls.tex": main_table(table, alphas), "quantiles.tex": group_table(table), "robustness.tex": plain_table(small["robustness"], ["specification", "n_months", "mean_ann_pct", "sharpe", "alpha", "t_alpha"]), "rankcorr.tex": plain_table(small["rank_correlations"], ["score", "mean_rank_corr", "t_stat", "share_positive", "n_years"]), "eventtime.tex": plain_table(small["event_time"].filter("event_month in (1, 3, 6, 9, 12)"), ["event_month", "q_low_car", "q_high_car", "ls_car", "ls_se", "n_filings"], 4)}
        for name, body in text.items():
            sinks.write_text(self.spark, body, f"{self.out}/{name}")
        return summary | {"overfitting": report}


def numbers(summary: dict, report: dict, table: DataFrame, alphas: DataFrame, trials: DataFrame) -> str:
    """A macro for every number of the summary, the report, the two long-short portfolios and the trials."""
    made: dict[str, str] = {}

    def put(name: str, value) -> None:
        made[name] = f"{value:,}" if isinstance(value, int) else sinks.tex(value) if isinstance(value, str) else sinks.number(value)

    for source in (summary, report):
        for k, v in source.items():
            put(k, v)
    for r in table.filter("portfolio in ('LS', 'LS_net')").collect():
        for k in ("mean_ann_pct", "vol_ann_pct", "sharpe", "max_drawdown_pct", "sharpe_ci_lo", "sharpe_ci_hi"):
            put(f"{r['portfolio']}_{k}", r[k])
    for r in alphas.collect():
        put(f"{r['portfolio']}_alpha_{r['model']}", r["alpha_ann_pct"])
        put(f"{r['portfolio']}_t_{r['model']}", r["t_stat"])
    counts = trials.agg(F.count_if(F.col("sharpe") > 0).alias("trials_positive"), F.count_if(F.abs("t_alpha") > 2).alias("trials_significant"), F.count_if((F.abs("t_alpha") > 2) & (F.col("alpha") < 0)).alias("trials_significant_negative")).first()
    for k, v in counts.asDict().items():
        put(k, v)
    for r in trials.orderBy("sharpe", "variant").limit(1).collect():
        for k in ("variant", "mean_ann_pct", "alpha", "t_alpha", "max_drawdown_pct"):
            put(f"worst_{k}", r[k])
    return "\n".join(sinks.macro(sinks.camel(k), v) for k, v in made.items())


def main_table(table: DataFrame, alphas: DataFrame) -> str:
    rows = {r["portfolio"]: r for r in table.collect()}
    both = [rows[p] for p in ("LS", "LS_net") if p in rows]
    body = [[sinks.tex(label), *(sinks.number(r[key]) for r in both)] for label, key in (("Mean return (% p.a.)", "mean_ann_pct"), ("Volatility (% p.a.)", "vol_ann_pct"), ("Sharpe ratio", "sharpe"), ("Maximum drawdown (%)", "max_drawdown_pct"))]
    body.insert(3, [sinks.tex("Sharpe ratio, 95% bootstrap interval"), *(f"[{sinks.number(r['sharpe_ci_lo'])}, {sinks.number(r['sharpe_ci_hi'])}]" for r in both)])
    found = {(r["model"], r["portfolio"]): r for r in alphas.collect()}
    for model in dict.fromkeys(m for m, _ in found):
        body.append([f"{model} alpha (t)", *(f"{sinks.number(found[model, r['portfolio']]['alpha_ann_pct'])} ({sinks.number(found[model, r['portfolio']]['t_stat'])})" for r in both)])
    return sinks.table(["", "Gross", "Net"][: 1 + len(both)], body)


def group_table(table: DataFrame) -> str:
    models = [c[6:] for c in table.columns if c.startswith("alpha_")]
    rows = table.filter("portfolio rlike '^Q[0-9]+$'").orderBy(F.expr("cast(substring(portfolio, 2) as int)")).collect()
    body = [[r["portfolio"], *(sinks.number(r[c], 1 if c != "sharpe" else 2) for c in ("mean_ann_pct", "vol_ann_pct", "sharpe", "max_drawdown_pct")), *(f"{sinks.number(r[f'alpha_{m}'])} ({sinks.number(r[f't_{m}'])})" for m in models)] for r in rows]
    return sinks.table(["Group", "Mean", "Vol", "Sharpe", "Max DD", *(f"{m} alpha (t)" for m in models)], body)


def plain_table(rows: DataFrame, columns: list[str], digits: int = 2) -> str:
    def cell(x) -> str:
        return sinks.number(x, digits) if x is None or isinstance(x, float) else sinks.tex(str(x))

    return sinks.table(columns, [[cell(r[c]) for c in columns] for r in rows.select(*columns).orderBy(columns[0]).collect()])


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="python -m filingdelta.plans.stages")
    for name in ("index", "sections", "prices", "factors", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--refresh", action="store_true", help="make all stages anew")
    parser.add_argument("--placebo-draws", type=int, default=200)
    parser.add_argument("--min-names", type=int, default=5)
    a = parser.parse_args(argv)
    from filingdelta.session import get_session

    spark = get_session("filingdelta-stages")
    read = spark.read.parquet
    return Study(read(a.index), read(a.sections), read(a.prices), read(a.factors), a.out, a.refresh, a.placebo_draws, a.min_names).run()


if __name__ == "__main__":
    main()
