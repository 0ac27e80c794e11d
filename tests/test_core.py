import datetime as dt
import itertools
import json
import math
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from filingdelta.functions import text as X
from filingdelta.operators import diagnostics, filings, overfit, portfolio, ranking, similarity, stats
from filingdelta.plans import stages
from filingdelta.plans.queries import oracle_sql, queries
from filingdelta.sources import readers, sinks
from filingdelta.streaming.incremental import append_term_counts


def one(df):
    return df.first()[0]


def test_similarities(spark):
    rows = [("abc", "bcd", 0.5), ("aab", "abb", 1.0), ("a", "b", 0.0), ("", "", None)]
    df = spark.createDataFrame([(list(a), list(b)) for a, b, _ in rows], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in rows]
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [round(r[0], 12) for r in df.select(X.weighted_cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0]
    df = spark.createDataFrame([(["the", "risk"], ["the", "growth"], {"the": 0.0, "risk": 2.0, "growth": 2.0})], "a array<string>, b array<string>, m map<string,double>")
    assert round(one(df.select(X.weighted_cosine(F.col("a"), F.col("b")))), 12) == 0.5
    assert one(df.select(X.weighted_cosine(F.col("a"), F.col("b"), F.col("m")))) == 0.0
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "u array<double>, v array<double>")
    assert [r[0] and round(r[0], 6) for r in df.select(X.cosine(F.col("u"), F.col("v"))).collect()] == [0.707107, None]


def test_tokens(spark):
    df = spark.createDataFrame([("The café's RISK_1 risk a b2b growth-rate",)], "t string")
    assert one(df.select(X.tokens(F.col("t")))) == ["the", "risk", "growth", "rate"]


def test_html_and_items():
    page = "<html><head><title>T</title><style>x</style></head><body><ix:header><ix:hidden>h</ix:hidden></ix:header><div style='DISPLAY: none'>gone <b>too</b></div><p>Tom&nbsp;&#160;&amp;  Ann</p><table><tr><td>a</td><td>b</td></tr></table>x<br>y</body></html>"
    assert X.clean_html(page.encode()) == "Tom & Ann\na b\nx\ny"
    assert X.clean_html("plain <x> text\n\n  more ") == "plain text\nmore"
    assert X.clean_html("<DOCUMENT><TYPE>EX-1\nno</DOCUMENT><DOCUMENT><TYPE>10-K405\nyes</DOCUMENT>").endswith("yes") and X.clean_html(None) is None
    assert X.clean_html("<DOCUMENT><TYPE>EX-1\none</DOCUMENT><DOCUMENT>two</DOCUMENT>").endswith("one") and X.clean_html(b"\xff ok \xe2\x80\x8b") == "\ufffd ok"
    assert X.clean_html("<p>sp<b>li</b>t</p> zero\u200bwidth") == "split\nzerowidth" and X.clean_html("") == ""
    body = lambda w: " ".join([w] * 400)
    text = "\n".join(["Item 1A. Risk Factors", "Item 1B. Unresolved", "Item 7. Management's", "Item 7A. Quantitative", "Item 1. Business, see Item 1A. Risk Factors", "Item 1A. Risk Factors", body("danger"), "Item 1B. Unresolved Staff Comments", "Item 7. Management's Discussion", body("profit"), "Item 7A. Quantitative", "Item 8. Financial Statements"])
    assert "danger" in X.section_of(text, "1A") and "profit" not in X.section_of(text, "1A")
    assert X.section_of(text, "7").startswith("Item 7. Management's Discussion") and X.section_of("none", "7") == "" and X.section_of(None, "7") == ""
    assert X.section_of("see Item 7. Management " + body("x") + " see Item 8. Financial Statements", "7", 100).startswith("Item 7. Management")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["item 7. management ", "item 8. financial statements ", "\n", "word ", "Item 7A quantitative "]), max_size=12))
def test_longest_section(parts):
    """The sweep against all pairs of a heading and the first end after it."""
    text = "".join(parts)
    low, (start, end) = text.lower(), X.ITEMS["7"]
    want = ""
    for head in (r"^[\s\W]*", ""):
        ends = [m.start() for m in re.finditer(head + end, low, re.M)]
        spans = [text[m.start() : min(e for e in ends if e > m.start())] for m in re.finditer(head + start, low, re.M) if any(e > m.start() for e in ends)]
        if (best := max(spans, key=len, default="")) and len(best) >= 5:
            want = best.strip()
            break
    assert X.section_of(text, "7", 5) == want


def test_section_texts(spark):
    docs = spark.createDataFrame([(1, b"<p>Item 7. Management's</p><p>body body</p><p>Item 8. Financial Statements</p>"), (2, None), (3, b"")], "id long, content binary")
    found = {(r["id"], r["section"]): r["text"] for r in X.section_texts(docs, "content", 5).collect()}
    assert found[1, "full"].count("\n") == 2 and found[1, "7"] == "Item 7. Management's\nbody body" and found[1, "1A"] == ""
    assert len(found) == 9 and all(found[i, s] == "" for i in (2, 3) for s in ("full", "1A", "7"))


def test_process_corpus(spark, tmp_path):
    page = "<p>Item 7. Management's</p><p>" + "word " * 500 + "</p><p>Item 8. Financial Statements</p>"
    (tmp_path / "a.htm").write_text(page)
    index = spark.createDataFrame([("1", "0-1", "T", f"file:{tmp_path}/a.htm"), ("1", "0-2", "T", "missing.htm"), ("1", "0-3", "T", None)], "cik string, accession string, ticker string, path string")
    sections, filed = similarity.process_corpus(index, spark.read.format("binaryFile").load(str(tmp_path)))
    found = {r["accession"]: (r["len_full"], r["len_1A"], r["len_7"]) for r in filed.collect()}
    full = X.clean_html(page)
    assert found == {"0-1": (len(full), 0, len(X.section_of(full, "7"))), "0-2": (0, 0, 0)} and found["0-1"][2] > 2_000
    assert sections.count() == 6 and sections.columns == ["cik", "accession", "section", "text"]


def test_filings(spark):
    rows = [(1, "10-K", "2020-12-31", "2021-02-01", "a"), (1, "10-K", "2020-12-31", "2021-03-01", "b"), (1, "10-K/A", "2019-12-31", "2020-03-01", "c"), (1, "10-K", "2021-01-03", "2021-04-01", "d"), (1, "10-K", None, "2021-04-01", "e"), (1, "10-K405", "2021-12-31", "2022-02-01", "f")]
    df = spark.createDataFrame(rows, "cik long, form string, report_date string, filing_date string, accession string")
    found = filings.annual_filings(df, 2007, 2025)
    assert sorted((r["fiscal_year"], r["accession"]) for r in found.collect()) == [(2020, "d"), (2021, "f")]
    index = spark.createDataFrame([("x", y, dt.date(y, 12, 31), dt.date(y + 1, 2, 1), str(y)) for y in (2010, 2011, 2013, 2014)], "cik string, fiscal_year int, report_date date, filing_date date, accession string")
    assert sorted(r["accession"] for r in filings.pair_consecutive(index).collect()) == ["2011", "2014"]


def test_point_in_time_frequencies(spark):
    counts = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 1), (3, "b", 1), (3, "c", 2)], "doc_id long, term string, tf long")
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "doc_id long, month int")
    r = similarity.pit_cosine(counts, docs, spark.createDataFrame([(3, 2, 2)], "doc_id long, prev_doc_id long, month int")).first()
    wa, wb = math.log(2 / 2) + 1, math.log(2 / 1) + 1
    assert abs(r["cosine"] - wb * wb / (math.hypot(wb, 2 * wb) * math.hypot(wa, wb))) < 1e-12 and abs(r["jaccard"] - 1 / 3) < 1e-12


def test_ranking(spark):
    df = spark.createDataFrame([(1, f"T{i}", i / 10) for i in range(10)] + [(1, "N", None)] + [(2, "T", 0.1)], "fiscal_year int, ticker string, s double")
    found = {r["ticker"]: r["quantile"] for r in ranking.rank_cohort(df, "s", 5).collect()}
    assert len(found) == 10 and found["T0"] == 1 and found["T9"] == 5 and sorted(found.values()) == [k for k in range(1, 6) for _ in range(2)]
    ends = [dt.date(2020 + (m > 12), (m - 1) % 12 + 1, 28) for m in range(1, 13)]
    df = spark.createDataFrame([(f"T{i}", d, float(i)) for i, d in enumerate(ends)], "ticker string, d date, s double")
    found = {r["ticker"]: r["quantile"] for r in ranking.rank_trailing(df, "s", "d", 2, min_cohort=4).collect()}
    assert {t for t, q in found.items() if q is None} == {"T0", "T1", "T2"}
    assert {q for q in found.values() if q is not None} == {2}
    with pytest.raises(ValueError):
        ranking.rank_filings(df, "s", rule="none")


@pytest.mark.parametrize("block", [4_096, 7])
def test_trailing_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, dt.date(2010, 1, 1) + dt.timedelta(int(d)), None if i % 17 == 0 else float(s)) for i, (d, s) in enumerate(zip(rng.integers(0, 1500, 150), rng.integers(0, 25, 150), strict=True))]
    df = spark.createDataFrame(rows, "id long, d date, s double")
    found = {r["id"]: r["quantile"] for r in ranking.rank_trailing(df, "s", "d", 3, min_cohort=5, block_rows=block).collect()}
    want = {}
    for i, d, s in rows:
        if s is not None:
            window = [x for _, e, x in rows if x is not None and d - dt.timedelta(365) < e <= d]
            want[i] = min(int(sum(x < s for x in window) / len(window) * 3) + 1, 3) if len(window) >= 5 else None
    assert found == want


def test_cohort_in_blocks(spark):
    """Ranks of a cohort that is cut into parts, ties and nulls among the scores."""
    rng = np.random.default_rng(3)
    rows = [(i % 3, f"T{i:04}", None if i % 50 == 0 else float(s)) for i, s in enumerate(rng.integers(0, 40, 600))]
    df = spark.createDataFrame(rows, "fiscal_year int, ticker string, s double")
    whole = sorted(map(tuple, ranking.rank_cohort(df, "s", [3, 10]).collect()))
    assert whole == sorted(map(tuple, ranking.rank_cohort(df, "s", [3, 10], block_rows=50).collect())) and len(whole) == 2 * 588
    assert ranking.rank_cohort(df.limit(0), "s", 5).count() == 0


def business_days():
    return [d for k in range(731) if (d := dt.date(2020, 1, 1) + dt.timedelta(k)).weekday() < 5 and d.year < 2022]


def test_no_look_ahead(spark):
    days = business_days()
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, day int")
    ranked = spark.createDataFrame([("X", 2019, dt.date(2020, 2, 14), 5), ("Y", 2019, dt.date(2020, 2, 14), 1), ("Z", 2021, dt.date(2021, 12, 15), 5)], "ticker string, fiscal_year int, filing_date date, quantile int")
    positions = portfolio.build_positions(ranked, calendar)
    assert {(r["ticker"], r["entry"], r["exit"]) for r in positions.collect()} == {(t, dt.date(2020, 3, 2), dt.date(2021, 3, 1)) for t in "XY"}
    assert one(portfolio.build_positions(ranked, calendar, lag=1).select("entry")) == dt.date(2020, 4, 1)
    inside = lambda d: dt.date(2020, 3, 2) < d <= dt.date(2021, 3, 1)
    rets = spark.createDataFrame([(t, i, (0.01 if t == "X" else 0.0) if inside(d) else 1.0) for t in "XY" for i, d in enumerate(days) if i], "ticker string, day int, ret double")
    q = portfolio.quantile_returns(portfolio.held_days(positions, rets, calendar), calendar, every_day=True)
    ls = portfolio.long_short(q, 5, 10.0, 1)
    live = {r["date"]: r["ls"] for r in ls.filter("ls is not null").collect()}
    assert min(live) == dt.date(2020, 3, 3) and max(live) == dt.date(2021, 3, 1) and set(live.values()) == {0.01}
    turn = {r["date"]: r["turnover"] for r in q.filter("quantile = 5").collect()}
    assert turn[dt.date(2020, 3, 3)] == 1.0 and turn[dt.date(2020, 3, 4)] == 0.0 and turn[dt.date(2021, 3, 2)] == 1.0
    months = {r["month"]: r for r in portfolio.to_monthly(ls).collect()}
    assert abs(months[dt.date(2020, 4, 30)]["ls"] - (1.01 ** sum(d.year == 2020 and d.month == 4 for d in days) - 1)) < 1e-12


def test_turnover_against_weights(spark):
    """Numbers of names and stayers against the weights themselves; overlapping positions, gaps and missing returns."""
    rng = np.random.default_rng(2)
    calendar = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), i) for i in range(60)], "date date, day int")
    spans = [(int(q), f"T{t}", int(a), None if k % 9 == 0 else int(a + n)) for k, (q, t, a, n) in enumerate(zip(rng.integers(1, 3, 40), rng.integers(0, 12, 40), rng.integers(0, 55, 40), rng.integers(0, 20, 40), strict=True))]
    rets = [(f"T{t}", d, float(rng.normal())) for t in range(12) for d in range(1, 60) if rng.random() < 0.9]
    positions = spark.createDataFrame(spans, "quantile int, ticker string, entry_day int, exit_day int")
    returns = spark.createDataFrame(rets, "ticker string, day int, ret double")
    found = {(r["quantile"], r["day"]): (r["ret"], r["n"], r["turnover"]) for r in portfolio.quantile_returns(portfolio.held_days(positions, returns, calendar), calendar, every_day=True).collect()}
    value = {(t, d): r for t, d, r in rets}
    for q in (1, 2):
        before = {}
        for d in range(60):
            names = {t for k, t, a, b in spans if k == q and a < d <= (59 if b is None else b) and (t, d) in value}
            w = dict.fromkeys(names, 1 / len(names) if names else 0)
            ret, n, turn = found[q, d]
            assert n == len(names) and (ret is None if not names else abs(ret - sum(value[t, d] for t in names) / n) < 1e-12)
            assert abs(turn - sum(abs(w.get(t, 0) - before.get(t, 0)) for t in {*w, *before})) < 1e-12
            before = w


def test_forward_returns(spark):
    days = business_days()
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, day int")
    prices = spark.createDataFrame([("X", d, 100.0 + i) for i, d in enumerate(days)] + [("Y", days[-1], 1.0)], "ticker string, date date, price double")
    rows = spark.createDataFrame([("X", dt.date(2020, 2, 14), 1), ("X", dt.date(2021, 2, 14), 2), ("Y", dt.date(2020, 2, 14), 3), ("Z", dt.date(2022, 2, 1), 4), ("X", None, 5)], "ticker string, filing_date date, at int")
    found = {r["at"]: r["fwd12"] for r in portfolio.forward_returns(rows, prices, calendar).collect()}
    a, b = days.index(dt.date(2020, 3, 2)), days.index(dt.date(2021, 3, 1))
    assert abs(found.pop(1) - ((100 + b) / (100 + a) - 1)) < 1e-12 and found == {2: None, 3: None, 4: None, 5: None}


def test_sections_similarity(spark):
    """Two firms by three years: scores of each section, missing ones null, lengths in bytes."""
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "ijklm"]
    index, texts = [], []
    for f, cik in enumerate(("1", "2")):
        for y in (2010, 2011, 2012):
            acc = f"{cik}-{y}"
            index.append((cik, f"T{cik}", y, dt.date(y, 12, 31), dt.date(y + 1, 2, 1 + f), acc))
            body = "é " + " ".join((words[f:] if y < 2012 else words[f : f + 12]) * 4)
            texts += [(acc, "full", body), (acc, "1A", body if y > 2010 else "short"), (acc, "7", None)]
    idx = spark.createDataFrame(index, "cik string, ticker string, fiscal_year int, report_date date, filing_date date, accession string")
    found = {r["accession"]: r for r in similarity.compute_similarity(idx, spark.createDataFrame(texts, "accession string, section string, text string"), 100).collect()}
    assert sorted(found) == ["1-2011", "1-2012", "2-2011", "2-2012"]
    r, q = found["1-2011"], found["1-2012"]
    assert abs(r["cos_full"] - 1) < 1e-12 and r["jac_full"] == 1.0 and r["cos_1a"] is None and r["cos_7"] is None and r["len_7"] == 0 and r["prev_fiscal_year"] == 2010
    assert 0 < q["cos_1a"] < 1 and q["jac_full"] == 12 / 40 and q["len_full"] == len(("é " + " ".join(words[:12] * 4)).encode())
    few = similarity.compute_similarity(idx, spark.createDataFrame(texts, "accession string, section string, text string"), 100, max_features=5).collect()
    assert len(few) == 4 and all(r["jac_full"] in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0) for r in few)


def test_statistics(spark):
    assert [stats.hac_lags(n) for n in (94, 100, 117, 200, 211, 1000)] == [3, 4, 4, 4, 4, 6]
    rng = np.random.default_rng(0)
    f, noise = rng.normal(0, 0.04, (600, 6)), rng.normal(0, 0.01, 600)
    y = 0.004 + f @ np.array([1.0, 0.2, -0.1, 0, 0, 0.1]) + noise
    fit = stats.hac_ols(y, f)
    assert abs(fit["alpha"] - 0.004) < 0.001 and abs(fit["betas"][0] - 1) < 0.02 and fit["t"] > 5 and fit["p"] < 0.001
    rows = [("s", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame([*rows, ("c", 0, 0.01), ("c", 1, 0.01), ("d", 0, 0.1), ("d", 1, -0.5), ("d", 2, 0.2)], "k string, m int, ret double")
    s = {r["k"]: r for r in stats.evaluate(df, ["k"], "m").collect()}
    e, m, lags = y - y.mean(), y.mean(), 5
    assert stats.hac_lags(600) == lags
    v = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    assert abs(s["s"]["t_mean_nw"] - m / (math.sqrt(v) / 600)) < 1e-9
    assert s["c"]["sharpe"] is None and s["c"]["t_mean_nw"] is None and abs(s["d"]["max_drawdown_pct"] + 50) < 1e-9
    factors = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(f)], "m int, `Mkt-RF` double, SMB double, HML double, RMW double, CMA double, Mom double")
    a = {(r["k"], r["model"]): r for r in stats.alphas(df, factors, ["k"], "m").collect()}
    assert abs(a["s", "FF5+MOM"]["t_stat"] - fit["t"]) < 1e-9 and a["c", "CAPM"]["t_stat"] is None and a["c", "CAPM"]["n_obs"] == 2
    daily = spark.createDataFrame([(dt.date(2020, 1, 2), 0.1), (dt.date(2020, 1, 3), 0.1), (dt.date(2020, 2, 3), None)], "date date, `Mkt-RF` double")
    assert [round(r["Mkt-RF"], 12) for r in stats.monthly_factors(daily, ["Mkt-RF"]).orderBy("month").collect()] == [0.21, 0.0]
    starts = np.random.default_rng(0).integers(0, 600, size=(2000, 100))
    draws = [[y[(a + k) % 600] for a in row for k in range(6)][:600] for row in starts[:40]]
    own = [np.mean(d) / np.std(d, ddof=1) * math.sqrt(12) for d in draws]
    windows = np.lib.stride_tricks.sliding_window_view(np.append(y, y[:5]), 6)[starts[:40]].reshape(40, -1)[:, :600]
    assert np.allclose(own, windows.mean(axis=1) / windows.std(axis=1, ddof=1) * math.sqrt(12))
    same = spark.createDataFrame([(k, float(i), 0.01 if k == "flat" else 2.0 * i) for k in ("flat", "line") for i in range(25)], "k string, x double, y double")
    rho = {r["k"]: r["rho"] for r in stats.rank_correlations(same, "x", "y", "k").collect()}
    assert rho["flat"] is None and abs(rho["line"] - 1) < 1e-12
    assert stats.rank_summary(stats.rank_correlations(same, "x", "y", "k")).first()["n_years"] == 1
    lo, hi = stats.sharpe_ci(y)
    assert lo < y.mean() / y.std(ddof=1) * math.sqrt(12) < hi and math.isnan(stats.sharpe_ci(y[:5])[0])


def test_event_time_and_shuffle(spark):
    panel = spark.createDataFrame([(t, y, q, m, 0.01 * (q == 5)) for y in (1, 2) for t, q in (("a", 1), ("b", 5)) for m in (1, 2, 3)], "ticker string, fiscal_year int, quantile int, event_month int, abnormal double")
    car = [(round(r["ls_car"], 12), r["n_cohorts"]) for r in diagnostics.event_car(panel).orderBy("event_month").collect()]
    assert car == [(0.01, 2), (0.02, 2), (0.03, 2)]
    rows = spark.createDataFrame([(i, i % 2, None if i == 3 else i / 10) for i in range(9)], "id long, fy int, s double")
    mixed = diagnostics.shuffle_within(rows, "s", "fy", "id", F.xxhash64("id"))
    for y in (0, 1):
        assert sorted((r["s"] for r in mixed.filter(F.col("fy") == y).collect()), key=str) == sorted((r["s"] for r in rows.filter(F.col("fy") == y).collect()), key=str)
    assert abs(one(diagnostics.share_below(spark.createDataFrame([(-1.0,), (0.5,), (1.0,)], "x double"), "x", 0.0)) - 1 / 3) < 1e-12


def test_overfitting(spark):
    x = np.random.default_rng(4).normal(0, 0.02, (240, 40))
    found = overfit.cscv(x, 8)
    assert found["n_combinations"] == 70 and 0.2 < found["pbo"] <= 1
    assert overfit.expected_max_sharpe(1.0, 1) == 0.0 and 2.0 < overfit.expected_max_sharpe(1.0, 54) < 2.6
    assert abs(overfit.deflated_sharpe(0.1, 0.1, 100, 0.0, 3.0) - 0.5) < 1e-12
    trials = spark.createDataFrame([(f"v{j}", i, float(x[i, j])) for i in range(60) for j in range(3)], "variant string, month int, ls double")
    c = np.corrcoef(x[:60, :3].T)
    assert abs(one(overfit.participation_ratio(trials)) - 9 / (c**2).sum()) < 1e-9
    found = overfit.report(trials, splits=4)
    assert found["n_trials"] == 3 and found["n_combinations"] == 6
    sr = x[:60, :3].mean(axis=0) / x[:60, :3].std(axis=0, ddof=1)
    assert abs(found["best_sharpe"] - sr.max() * math.sqrt(12)) < 1e-12 and found["best"] == f"v{sr.argmax()}"


def test_cscv_against_brute_force():
    x = np.random.default_rng(5).normal(0.001, 0.02, (50, 7))
    blocks = np.array_split(np.arange(50), 6)
    low = loss = 0
    halves = list(itertools.combinations(range(6), 3))
    for chosen in halves:
        inside = np.concatenate([blocks[b] for b in chosen])
        outside = np.concatenate([blocks[b] for b in range(6) if b not in chosen])
        sharpe = lambda rows: x[rows].mean(axis=0) / x[rows].std(axis=0, ddof=1)
        best = sharpe(inside).argmax()
        rank = (sharpe(outside) < sharpe(outside)[best]).sum() + 1
        low += rank / 8 <= 0.5
        loss += sharpe(outside)[best] < 0
    found = overfit.cscv(x, 6)
    assert found == {"n_combinations": 20, "pbo": low / 20, "prob_oos_loss": loss / 20} and len(halves) == 20


def test_sources(spark, tmp_path):
    block = {"form": ["10-K", "8-K"], "filingDate": ["2021-02-01", "2021-03-01"], "reportDate": ["2020-12-31", ""], "accessionNumber": ["0-1", "0-2"], "primaryDocument": ["x/a.htm", "b.htm"]}
    (tmp_path / "320_submissions.json").write_text(json.dumps({"tickers": ["AA", "AB"], "name": "A", "filings": {"recent": block, "files": []}}))
    (tmp_path / "77_submissions.json").write_text(json.dumps({"tickers": [], "name": "B", "filings": {"recent": block, "files": []}}))
    s = readers.read_submissions(spark, str(tmp_path / "*_submissions.json"))
    universe = readers.load_universe(s)
    assert [tuple(r) for r in universe.collect()] == [("0000000320", "AA", "A")]
    exploded = readers.explode_filings(s)
    assert exploded.count() == 4 and exploded.filter("report_date is null").count() == 2
    index = readers.filing_index(universe, exploded, 2007, 2025, {"AA": ["0000000077"]})
    assert [(r["cik"], r["filer_cik"], r["fiscal_year"]) for r in index.collect()] == [("0000000320", "0000000320", 2020)]
    assert one(exploded.filter("form = '10-K' and cik = '0000000320'").select(readers.document_path(F.col("cik"), F.col("accession"), F.col("document")))) == "raw/0000000320/01/a.htm"
    (tmp_path / "p.csv").write_text("Date,A.B,C\n2020-01-02,1.5,\n2020-01-03,,\n2020-01-06,NaN,2\n")
    p = readers.read_prices(spark, str(tmp_path / "p.csv"))
    assert {(r["ticker"], str(r["date"]), r["price"]) for r in p.collect() if r["price"] is not None} == {("A.B", "2020-01-02", 1.5), ("C", "2020-01-06", 2.0)} and p.count() == 4
    body = "prose\n,Mkt,RF\n20200102, 1.00, -99.99\n20200103,-2.00,0.01\n\n20200104,9,9\n"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.CSV", body)
    assert [tuple(r)[1:] for r in readers.read_factor_zip(spark, str(tmp_path / "f.zip"), ["Mkt-RF", "RF"]).collect()] == [(0.01, None), (-0.02, 0.0001)]


def test_client(tmp_path):
    calls, waits = [], []
    answers = {"u": [(429, b""), (500, b""), (200, b"ok")], "gone": [(404, b"")], "v": [(200, b"v")]}

    def transport(url):
        calls.append(url)
        return answers[url].pop(0)

    client = readers.Client(transport, str(tmp_path), readers.RateLimiter(1e9), sleep=waits.append)
    assert client.fetch("d/a", ["gone", "u"])[1] is None and waits == [10.0, 20.0] and calls == ["gone", "u", "u", "u"]
    assert client.fetch("d/a", ["u"])[0].endswith("d/a") and len(calls) == 4
    answers["gone"] = [(404, b"")]
    assert client.fetch("d/b", ["gone"])[1].startswith("FileNotFoundError")
    plan = readers.waits(9)
    assert [plan.send(False) for _ in plan] == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0, 60.0, None]
    clock = iter([0.0, 0.0, 10.0])
    slept = []
    limiter = readers.RateLimiter(2, lambda: next(clock), slept.append)
    for _ in range(3):
        limiter.wait()
    assert slept == [0.5]


def test_sinks(spark, tmp_path):
    assert sinks.number(None) == "--" and sinks.number(1.236) == "1.24" and sinks.tex("a_b|c%") == "a\\_b$\\mid$c\\%" and sinks.camel("dsr_eff 95") == "dsrEffNineFive"
    assert sinks.macro("x", "1") == "\\newcommand{\\x}{1}" and "\\midrule" in sinks.table(["a", "b"], [["1", "2"]])
    df = spark.createDataFrame([(1, float(i)) for i in range(11)] + [(1, 100.0)], "k int, v double")
    box = sinks.box_stats(df, "k", "v").first()
    assert box["high"] == 10.0 and box["n_inside"] == 11
    assert sum(r["n"] for r in sinks.histogram(df, "v", 5).collect()) == 12
    sinks.write_csv(df, str(tmp_path / "c"), 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["v"] == "0.00"
    sinks.write_json({"a": float("nan"), "b": 1}, str(tmp_path / "j"))
    assert json.loads((tmp_path / "j").read_text()) == {"a": None, "b": 1}


def test_sections_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("1", "0-1", "full", "a\nb"), ("1", "0-1", "7", None), ("2", "0-2", "full", "")], "cik string, accession string, section string, text string")
    sinks.write_sections(rows, str(tmp_path / "s"))
    assert {tuple(r) for r in sinks.read_sections(spark, str(tmp_path / "s")).collect()} == {("1", "01", "full", "a\nb"), ("1", "01", "7", ""), ("2", "02", "full", "")}
    df = spark.createDataFrame([("b", 2.0, "2009-03-31"), ("a", float("nan"), None), ("c", None, "2010-01-01")], "variant string, sharpe double, d string")
    assert sinks.counts_of(df, ["sharpe", "d"]).first().asDict() == {"n": 3, "n_sharpe": 1, "n_d": 2}
    assert df.select(sinks.month_name(F.to_date("d"))).first()[0] == "March 2009"
    bars = sinks.sharpe_bars(spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", -1.0)], "variant string, sharpe double"))
    assert [(r["place"], r["variant"]) for r in bars.orderBy("place").collect()] == [(1, "c"), (2, "a"), (3, "b")]
    table = spark.createDataFrame([("Q2", 1.0, 2.0, 3.0), ("LS", 1.0, 2.0, 3.0), ("LS_net", 1.0, 2.0, 3.0)], "portfolio string, mean_ann_pct double, `alpha_A+B` double, `t_A+B` double")
    assert [r["portfolio"] for r in sinks.quantile_bars(table, "A+B").collect()] == ["LS", "Q2"]


def test_downloads(spark, tmp_path):
    block = {"form": ["10-K"], "filingDate": ["2021-02-01"], "reportDate": ["2020-12-31"], "accessionNumber": ["0-1"], "primaryDocument": ["x/a.htm"]}
    older = block | {"filingDate": ["2011-02-01"], "reportDate": ["2010-12-31"], "accessionNumber": ["0-9"]}
    answers = {"s/CIK0000000320.json": json.dumps({"tickers": ["AA"], "name": "A", "filings": {"recent": block, "files": [{"name": "CIK0000000320-submissions-001.json"}]}}), "s/CIK0000000320-submissions-001.json": json.dumps(older), "d/320/01/x/a.htm": "new", "d/320/09/0-9.txt": "old"}
    client = readers.Client(lambda url: (200, answers[url].encode()) if url in answers else (404, b""), str(tmp_path / "cache"), readers.RateLimiter(1e9))
    paths = readers.submission_pages(client, "320", "s/{name}")
    assert len(paths) == 2
    first, more = readers.read_submissions(spark, paths[0]), readers.read_pages(spark, paths[1:])
    index = readers.filing_index(readers.load_universe(first), readers.explode_filings(first, more), 2007, 2025, {})
    found = {r["fiscal_year"]: r for r in readers.download_universe(index, client, "d/{cik}/{accession}/{document}", str(tmp_path / "index")).collect()}
    assert found[2020]["path"] == "raw/0000000320/01/a.htm" and found[2010]["path"] == "raw/0000000320/09/0-9.txt" and found[2020]["error"] is None
    assert (tmp_path / "cache" / found[2010]["path"]).read_text() == "old"
    calls = []

    def source(symbols):
        calls.append(symbols)
        return spark.createDataFrame([(x, dt.date(2020, 1, 2), 1.0) for x in symbols], "ticker string, date date, price double")

    for _ in range(2):
        prices = readers.download_prices(spark, spark.createDataFrame([("B.A",)], "ticker string"), source, str(tmp_path / "prices"))
    assert {r["ticker"] for r in prices.collect()} == {"B-A", "SPY"} and calls == [["B-A", "SPY"]]


def test_clashing_names_and_empty_tables(spark):
    """Columns named like what operators make inside stay as they are; empty tables give empty results."""
    days = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), i) for i in range(90)], "date date, day int")
    rows = spark.createDataFrame([("X", 2019, dt.date(2020, 1, 5), 0.5, "r", "n", "k", "m")], "ticker string, fiscal_year int, filing_date date, s double, row string, n string, place string, month_at string")
    assert portfolio.first_trading_day(rows, "filing_date", days).select("row", "n", "place", "month_at", "entry_day").first() == ("r", "n", "k", "m", 31)
    assert ranking.rank_cohort(rows, "s", 1, min_cohort=1).drop("filing_date").first() == ("X", 2019, 0.5, "r", "n", "k", "m", 1)
    assert diagnostics.shuffle_within(rows, "s", "fiscal_year", "ticker", F.lit(1)).columns == rows.columns
    none = rows.limit(0)
    assert portfolio.build_positions(ranking.rank_cohort(none, "s", 1), days).count() == 0 and ranking.rank_trailing(none, "s", "filing_date").count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two two"), (3, "two")], "doc_id long, text string")
    assert {tuple(r) for r in similarity.term_counts(docs).collect()} == {(3, "one", 1), (3, "two", 3)}
    assert similarity.top_terms(similarity.term_counts(docs.limit(0)), 5).count() == 0
    assert sinks.box_stats(spark.createDataFrame([(1, None)], "k int, v double"), "k", "v").count() == 0


def test_odd_rows_of_core_operators(spark):
    """Nulls, ties and repeated rows by value."""
    d = dt.date
    index = spark.createDataFrame([("x", 2010, d(2010, 12, 31), d(2011, 2, 1), "a"), ("x", 2011, d(2011, 12, 31), d(2012, 2, 1), "b"), ("x", 2011, d(2011, 12, 31), d(2012, 2, 1), "b"), ("x", 2012, None, None, "c"), (None, 2013, d(2013, 12, 31), d(2014, 2, 1), "d")], "cik string, fiscal_year int, report_date date, filing_date date, accession string")
    assert [(r["accession"], r["prev_accession"], r["gap_days"]) for r in filings.pair_consecutive(index).collect()] == [("b", "a", 365)]
    assert filings.pair_consecutive(index.limit(0)).count() == 0
    forms = spark.createDataFrame([(1, "10-K", "2020-12-31", None, "b"), (1, "10-K", "2020-12-31", "2021-01-01", "a"), (1, "10-K", "2020-12-31", None, "b"), (None, "10-K", "2020-12-31", "2021-01-01", "z")], "cik long, form string, report_date string, filing_date string, accession string")
    assert sorted((str(r["cik"]), r["accession"]) for r in filings.annual_filings(forms, 2007, 2025).collect()) == [("1", "b"), ("None", "z")]
    calendar = spark.createDataFrame([(d(2020, 1, 1) + dt.timedelta(i), i) for i in range(70)], "date date, day int")
    prices = spark.createDataFrame([("X", d(2020, 1, 1), 100.0), ("X", d(2020, 1, 2), None), ("X", d(2020, 1, 3), 110.0), ("X", d(2020, 1, 4), 121.0), ("Y", None, 5.0), ("X", d(2020, 2, 1), 132.0), ("X", d(2020, 3, 1), 66.0)], "ticker string, date date, price double")
    assert [(r["ticker"], r["day"], round(r["ret"], 12)) for r in portfolio.daily_returns(prices, calendar).collect()] == [("X", 3, 0.1)]
    assert portfolio.daily_returns(prices.limit(0), calendar).count() == 0 and portfolio.trading_calendar(prices.limit(0)).count() == 0
    assert portfolio.trading_calendar(prices).count() == 6
    first = diagnostics.first_day_prices(prices, calendar)
    base = first.withColumn("price", F.lit(10.0)).select("month", "price")
    events = spark.createDataFrame([("X", 2019, d(2019, 12, 5), 1), ("X", 2019, d(2019, 12, 5), 1), ("X", 2019, None, 1), ("Q", 2019, d(2019, 12, 5), 1), (None, 2019, d(2019, 12, 5), 1)], "ticker string, fiscal_year int, filing_date date, quantile int")
    found = sorted((r["event_month"], round(r["ret"], 12), r["bench"], round(r["abnormal"], 12)) for r in diagnostics.event_returns(events, first, base).collect())
    assert found == [(1, 0.32, 0.0, 0.32)] * 2 + [(2, -0.5, 0.0, -0.5)] * 2
    rows = spark.createDataFrame([(1, "g", 0.5), (1, "g", 0.5), (2, "g", None), (3, None, 0.1), (4, None, 0.2)], "id long, fy string, s double")
    mixed = diagnostics.shuffle_within(rows.filter("fy is not null"), "s", "fy", "id", -F.col("id"))
    assert sorted((r["id"], r["s"]) for r in mixed.collect() if r["s"] is not None) == [(1, 0.5), (2, 0.5)] and mixed.count() == 3
    counts = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "doc_id long, term string, tf long")
    months = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "doc_id long, month int")
    pairs = spark.createDataFrame([(2, 1, 2), (3, 1, 2), (9, 8, 2)], "doc_id long, prev_doc_id long, month int")
    assert {(r["doc_id"], r["prev_doc_id"], r["cosine"] and round(r["cosine"], 12), r["jaccard"]) for r in similarity.pit_cosine(counts, months, pairs).collect()} == {(2, 1, 1.0, 1.0), (3, 1, None, 0.0)}
    ties = similarity.top_terms(spark.createDataFrame([(1, "b", 1), (1, "a", 1), (2, "c", 1)], "doc_id long, term string, tf long"), 2)
    assert [r["term"] for r in ties.collect()] == ["a", "b"]
    box = sinks.box_stats(spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (None, 1.0)], "k int, v double"), "k", "v").collect()
    assert [(r["k"], r["q25"], r["median"], r["high"], r["n_inside"]) for r in box] == [(1, 2.0, 2.0, 2.0, 2)]
    flat = spark.createDataFrame([("k", i, 0.0) for i in range(5)], "k string, m int, ret double")
    r = stats.evaluate(flat, ["k"], "m").first()
    assert (r["n_months"], r["sharpe"], r["t_mean_nw"], r["max_drawdown_pct"], r["hit_rate"]) == (5, None, None, 0.0, 0.0)
    assert stats.evaluate(flat.limit(0), ["k"], "m").count() == 0


def test_all_stages(spark, tmp_path):
    """The whole study over a made market: every stage's table, cached on the second run."""
    rng = np.random.default_rng(1)
    days = [d for k in range(1600) if (d := dt.date(2010, 1, 1) + dt.timedelta(k)).weekday() < 5]
    tickers = [f"T{i:02}" for i in range(40)] + ["SPY"]
    prices = spark.createDataFrame([(t, d, float(p)) for t in tickers for d, p in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days)))), strict=True)], "ticker string, date date, price double")
    names = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom"]
    factors = spark.createDataFrame([(d, *map(float, rng.normal(0, 0.005, 6)), 0.0001) for d in days], "date date, " + ", ".join(f"`{n}` double" for n in names) + ", RF double")
    index, sections = [], []
    for i, t in enumerate(tickers[:-1]):
        for y in (2009, 2010, 2011, 2012):
            acc = f"{i}-{y}"
            index.append((str(i), t, y, dt.date(y, 12, 31), dt.date(y + 1, 2, 1 + i % 20), acc))
            words = " ".join(f"{chr(97 + int(a))}{chr(97 + int(b))}" for a, b in rng.integers(0, 20, (60, 2)))
            sections += [(acc, s, words if s != "7" or i % 2 else "") for s in ("full", "1A", "7")]
    index = spark.createDataFrame(index, "cik string, ticker string, fiscal_year int, report_date date, filing_date date, accession string")
    sections = spark.createDataFrame(sections, "accession string, section string, text string")
    study = stages.Study(index, sections, prices, factors, str(tmp_path / "out"), draws=3, min_names=2, min_bytes=50, split="2012-12-31")
    summary = study.run()
    assert summary["n_pairs"] == 120 and summary["n_pairs_with_1a"] == 120 and summary["n_pairs_with_7"] == 60 and summary["placebo_n_draws"] == 3
    assert study.trials()[0].count() == summary["overfitting"]["n_trials"] >= 40 and study.placebo().count() == 3
    table = {r["portfolio"]: r for r in study.portfolio()[1].collect()}
    assert sorted(table) == ["LS", "LS_net", "Q1", "Q2", "Q3", "Q4", "Q5"] and table["LS"]["sharpe_ci_lo"] < table["LS"]["sharpe"] < table["LS"]["sharpe_ci_hi"] and table["Q1"]["sharpe_ci_lo"] is None
    assert {r["specification"] for r in study.robustness().collect()} == {"main", "trailing", "main, to 2012-12-31", "main, after 2012-12-31"}
    assert study.rank_correlations().count() == 6 and study.event_time().count() == 12
    for name in ("numbers.tex", "main_ls.tex", "quantiles.tex", "robustness.tex", "rankcorr.tex", "eventtime.tex", "summary.json", "overfitting.json"):
        assert (tmp_path / "out" / name).stat().st_size > 100, name
    assert "\\newcommand{\\nPairs}{120}" in (tmp_path / "out" / "numbers.tex").read_text()
    before = (tmp_path / "out" / "similarity" / "_SUCCESS").stat().st_mtime_ns
    assert stages.Study(index, sections, prices, factors, str(tmp_path / "out")).similarity().count() == 120
    assert (tmp_path / "out" / "similarity" / "_SUCCESS").stat().st_mtime_ns == before


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "risk risk growth"), (2, "risk")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = append_term_counts(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert {(r["doc_id"], r["term"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "risk", 2), (1, "growth", 1), (2, "risk", 1)}


def test_entry(spark):
    assert set(oracle_sql()) <= set(queries()) and set(queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["ff_alpha", "html_to_text", "extract_item", "bootstrap_ci", "process_corpus"])
def test_queries_without_sql_run(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.01").count() > 0
