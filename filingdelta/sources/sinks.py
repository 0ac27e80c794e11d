"""Sinks: CSV, JSON and LaTeX of small result tables, and the data behind figures."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """One CSV file of a small table, doubles with so many digits."""
    columns = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*[F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(df.columns, columns, strict=True)]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def as_json(value: dict) -> str:
    return json.dumps({k: None if isinstance(v, float) and math.isnan(v) else v for k, v in value.items()}, indent=2, default=float)


def write_json(value: dict, path: str) -> None:
    with open(path, "w") as f:
        f.write(as_json(value))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, to any store that Spark writes; a file that is there is replaced."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def camel(name: str) -> str:
    """A macro's name: letters only, digits spelt out."""
    digits = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine")
    parts = re.split(r"[^A-Za-z0-9]+", re.sub(r"\d", lambda m: f"_{digits[int(m[0])]}_", name))
    return parts[0] + "".join(p[:1].upper() + p[1:] for p in parts[1:])


def number(x: float | None, digits: int = 2) -> str:
    return "--" if x is None or math.isnan(x) else f"{x:.{digits}f}"


def tex(text: str) -> str:
    """LaTeX of plain text."""
    return "".join({"|": "$\\mid$"}.get(c, "\\" + c if c in "_%&" else c) for c in text)


def macro(name: str, value: str) -> str:
    return f"\\newcommand{{\\{name}}}{{{value}}}"


def table(columns: list[str], rows: list[list[str]]) -> str:
    body = [" & ".join(map(tex, columns)) + " \\\\", "\\midrule", *(" & ".join(r) + " \\\\" for r in rows)]
    return "\n".join(["\\begin{tabular}{l" + "r" * (len(columns) - 1) + "}", "\\toprule", *body, "\\bottomrule", "\\end{tabular}"])


def write_sections(sections: DataFrame, path: str) -> None:
    """Text files of sections (cik, accession, section, text), one folder a filing and section; a null text is empty."""
    rows = sections.select("cik", F.regexp_replace("accession", "-", "").alias("accession"), "section", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("cik", "accession").write.mode("overwrite").partitionBy("cik", "accession", "section").text(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cik, accession, section, text) of write_sections(); accessions are without dashes."""
    return spark.read.schema("value string, cik string, accession string, section string").text(path, wholetext=True).select("cik", "accession", "section", F.regexp_replace("value", r"\n$", "").alias("text"))


def month_name(day: Column) -> Column:
    """As in `March 2009`."""
    return F.date_format(day, "MMMM yyyy")


def counts_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the rows, and for each column those that have a value."""
    return df.agg(F.count("*").alias("n"), *[F.count(F.nanvl(c, F.lit(None)) if t in ("double", "float") else F.col(c)).alias(f"n_{c}") for c, t in df.select(*columns).dtypes])


def quantile_bars(table: DataFrame, model: str) -> DataFrame:
    """Bars of the groups Q1.. and LS of an evaluation table: mean, alpha and t of a model, by name."""
    kept = table.filter(F.col("portfolio").rlike("^(Q[0-9]+|LS)$"))
    return kept.select("portfolio", "mean_ann_pct", F.col(f"`alpha_{model}`").alias("alpha"), F.col(f"`t_{model}`").alias("t_stat")).orderBy("portfolio")


def sharpe_bars(trials: DataFrame, column: str = "sharpe") -> DataFrame:
    """Rows (place, variant, sharpe) of the variants by Sharpe ratio, ties by name. A row a variant: one task orders them."""
    return trials.select(F.row_number().over(Window.orderBy(column, "variant")).alias("place"), "variant", F.col(column).alias("sharpe"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles of value for each key and the whiskers: the extreme values within 1.5 interquartile ranges. Null values
    and keys without a value are left out."""
    q = df.filter(F.col(value).isNotNull()).groupBy(key).agg(*[F.expr(f"percentile(`{value}`, {p})").alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    near = df.select(key, value).join(q, key).filter(F.col(value).between(F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))))
    return near.groupBy(key, "q25", "median", "q75").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n_inside"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Rows (bin, n), bins from the least to the largest value."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
