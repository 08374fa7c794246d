"""Panel sources from raw vendor tables: membership, monthly returns, names, industry history, sectors, macro."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expand import last_value_per_month, latest_per_key
from .cache import empty_table
from .text import parse_factor_csv, parse_range_list

DELISTING_SCHEMA = "permno int, date_eom date, dlret double, dlstcd int"
FIRST_DATE, LAST_DATE = date(1900, 1, 1), date(9999, 12, 31)


def primary_issue(members: DataFrame, index_id: str) -> DataFrame:
    """gvkey and the least iid (as a string) it ever had in the index."""
    return members.where(F.col("gvkeyx") == index_id).groupBy("gvkey").agg(F.min("iid").alias("iid"))


def membership(members: DataFrame, index_id: str, start: date, end: date) -> DataFrame:
    """Spans of the primary issues that overlap [start, end]; an open span ends at ``end``."""
    inside = members.where((F.col("gvkeyx") == index_id) & (F.col("from") <= F.lit(end)) & (F.col("thru").isNull() | (F.col("thru") >= F.lit(start))))
    return inside.join(primary_issue(members, index_id), ["gvkey", "iid"]).select(
        F.expr("try_cast(gvkey AS int)").alias("permno"), "gvkey", "iid", F.col("from").cast("date").alias("start"), F.coalesce(F.col("thru").cast("date"), F.lit(end)).alias("end_date")
    )


def monthly_returns(months: DataFrame, members: DataFrame, index_id: str, start: date, end: date) -> DataFrame:
    """Returns in fractions, shares in thousands, and market value of the primary issues."""
    kept = months.where(F.col("datadate").between(F.lit(start), F.lit(end))).join(primary_issue(members, index_id), ["gvkey", "iid"])
    return kept.select(
        F.expr("try_cast(gvkey AS int)").alias("permno"),
        F.last_day("datadate").alias("date_eom"),
        (F.col("trt1m").cast("double") / 100).alias("ret"),
        F.col("prccm").cast("double").alias("prc"),
        (F.col("cshoq").cast("double") * 1000).alias("shrout"),
    ).withColumn("mktcap", F.abs("prc") * F.col("shrout"))


def _span(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"namedt": F.make_date(F.col("year1").cast("int"), F.lit(1), F.lit(1)), "nameenddt": F.make_date(F.col("year2").cast("int"), F.lit(12), F.lit(31))})


def stock_names(names: DataFrame, members: DataFrame, index_id: str) -> DataFrame:
    """Name history of the index's firms, a year pair as a span."""
    kept = names.join(members.where(F.col("gvkeyx") == index_id).select("gvkey"), "gvkey", "left_semi")
    return _span(kept).select(
        F.expr("try_cast(gvkey AS int)").alias("permno"), F.col("tic").alias("ticker"), F.col("conm").alias("comnam"), F.expr("try_cast(sic AS int)").alias("siccd"), "namedt", "nameenddt",
        F.lit(None).cast("int").alias("shrcd"), F.lit(None).cast("int").alias("exchcd"),
    )


def sic_history(names: DataFrame, members: DataFrame, index_id: str) -> DataFrame:
    return stock_names(names.where("sic is not null"), members, index_id).select("permno", "namedt", "nameenddt", "siccd")


def sector_links(company: DataFrame, members: DataFrame, index_id: str) -> DataFrame:
    """Current sectors with a validity span from the first entry to the deletion, open ends as sentinels."""
    first = members.where(F.col("gvkeyx") == index_id).groupBy("gvkey").agg(F.min("from").alias("first_in"))
    return company.join(first, "gvkey").select(
        F.expr("try_cast(gvkey AS int)").alias("permno"), "gvkey", F.coalesce(F.col("first_in").cast("date"), F.lit(FIRST_DATE)).alias("linkdt"),
        F.coalesce(F.col("dldte").cast("date"), F.lit(LAST_DATE)).alias("linkenddt"), "gsector", "ggroup", "gind", "gsubind",
    )


def no_delistings(spark: SparkSession) -> DataFrame:
    return empty_table(spark, DELISTING_SCHEMA)


def with_delistings(monthly: DataFrame, delistings: DataFrame) -> DataFrame:
    """``ret_total``: both returns compounded where both are known, else the one that is."""
    joined = monthly.join(delistings, ["permno", "date_eom"], "left")
    both = (1 + F.col("ret")) * (1 + F.col("dlret")) - 1
    return joined.withColumn("ret_total", F.when(F.col("ret").isNotNull() & F.col("dlret").isNotNull(), both).otherwise(F.coalesce("ret", "dlret")))


def latest_names(names: DataFrame) -> DataFrame:
    return latest_per_key(names, ["permno"], "nameenddt", ["ticker", "comnam"]).select("permno", "ticker", "comnam")


def macro_table(series: dict[str, DataFrame]) -> DataFrame:
    """Month-end values of daily series, joined in full on the month."""
    out = None
    for name, daily in series.items():
        monthly = last_value_per_month(daily, name)
        out = monthly if out is None else out.join(monthly, "date_eom", "full")
    return out


def load_macro_sources(series: dict[str, DataFrame], start: date, end: date) -> DataFrame:
    """Macro values of the months between two dates."""
    return macro_table(series).where(F.col("date_eom").between(F.lit(start), F.lit(end)))


def load_factor_sources(factor_lines: DataFrame, range_lines: DataFrame) -> dict[str, DataFrame]:
    """Monthly factors and industry ranges from the lines of their files."""
    return {"ff5": parse_factor_csv(factor_lines), "ff12_def": parse_range_list(range_lines)}


def load_panel_sources(tables: dict[str, DataFrame], index_id: str, start: date, end: date, spark: SparkSession, keep: DataFrame | None = None) -> dict[str, DataFrame]:
    """All equity sources from the raw tables ``members``, ``months``, ``names`` and ``company``; with ``keep`` (a development sample) only its permnos."""
    out = {
        "members": membership(tables["members"], index_id, start, end),
        "monthly": with_delistings(monthly_returns(tables["months"], tables["members"], index_id, start, end), no_delistings(spark)),
        "stocknames": stock_names(tables["names"], tables["members"], index_id),
        "sic_history": sic_history(tables["names"], tables["members"], index_id),
        "gics": sector_links(tables["company"], tables["members"], index_id),
    }
    if keep is not None:
        out = {k: v.join(keep.select("permno"), "permno", "left_semi") for k, v in out.items()}
    return out | {"stocknames_latest": latest_names(out["stocknames"])}
