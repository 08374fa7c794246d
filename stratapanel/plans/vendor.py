"""Raw vendor tables, made of the star-schema test tables, and small texts in the vendors' formats."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources import raw
from .testbed import CONFIG, RISK_FREE, factors, ff12_table, macro_daily, returns, table

INDEX, OTHER_INDEX = "000003", "000010"

FACTOR_TEXT = """Factors by month, made for tests
The 1-month rate is from elsewhere

,Mkt-RF,SMB,HML,RMW,CMA,RF
202001,   -0.11,  -4.40,  -6.25,  -1.20,  -2.31,   0.13
202002,   -8.13,   0.04,  -3.80,  -1.50,  -2.52,   0.12
202003,  -13.38,  -8.28, -13.88,  -1.56,   1.19,   0.13

 Annual Factors: January-December
2020,   23.66,  12.29, -46.56, -21.66, -11.42,   0.45
202004,   13.65,   2.56,  -1.34,   2.70,  -1.04,   0.00
"""
RANGE_TEXT = """ 1 NoDur  Consumer Nondurables -- Food, Tobacco
          0100-0999
          2000-2399

 2 Durbl  Consumer Durables
          2500-2519

12 Other  Other
"""
SERIES_TEXT = """DATE,VALUE
2020-01-02,1.88
2020-01-30,1.57
2020-01-31,.
2020-02-27,NA
2020-02-28,1.13
2020-03-02,
2020-03-31,0.70
not a date,1.00
"""


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    """``file``, ``pos`` and ``line`` of a text at hand, as the parsers take them."""
    return spark.createDataFrame([("inline", k, line) for k, line in enumerate(text.split("\n"))], "file string, pos int, line string")


def _gvkey(key: str = "s_suppkey"):
    return F.lpad(F.col(key).cast("string"), 6, "0")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``members``, ``months``, ``names`` and ``company``: two issues of some firms, open and closed spans, returns after an index, negative prices, quarterly shares, odd codes."""
    s = table(spark, sf_dir, "supplier").withColumns({"gvkey": _gvkey(), "k": F.col("s_suppkey").cast("int")})
    k = F.col("k")

    def member(iid: str, index: str, start, end, where):
        return s.where(where).select("gvkey", F.lit(iid).alias("iid"), F.lit(index).alias("gvkeyx"), start.alias("from"), end.alias("thru"))

    none = F.lit(None).cast("date")
    members = member("01", INDEX, F.date_add(F.lit(date(1995, 2, 10)), k % 400), F.when(k % 3 != 0, F.date_add(F.lit(date(1999, 5, 20)), k % 500)), F.lit(True))
    members = members.unionByName(member("02", INDEX, F.lit(date(1994, 1, 1)), none, k % 4 == 0))
    members = members.unionByName(member("01", INDEX, F.date_add(F.lit(date(2000, 11, 15)), k % 60), none, (k % 5 == 1) & (k % 3 != 0)))
    members = members.unionByName(member("00", OTHER_INDEX, F.lit(date(1994, 1, 1)), none, k % 7 == 0))
    prices = returns(spark, sf_dir).withColumn("gvkey", _gvkey("permno"))
    quarter = F.month("date_eom") % 3 == 0
    months = prices.select(
        "gvkey", F.lit("01").alias("iid"), F.col("date_eom").alias("datadate"), F.when(F.col("permno") % 9 == 0, -F.col("prc")).otherwise(F.col("prc")).alias("prccm"),
        (F.col("ret") * 100).alias("trt1m"), F.when(quarter, F.col("shrout") / 1000).alias("cshoq"), F.lit(11).alias("exchg"),
    )
    months = months.unionByName(months.where(F.col("gvkey").endswith("4")).withColumn("iid", F.lit("02")))
    sic = F.when(k % 13 == 0, F.lit("n/a")).otherwise((k * 97 % 10000).cast("string"))

    def name(tic: str, code, first: int, last: int, where):
        return s.where(where).select("gvkey", F.col("s_name").alias("conm"), F.concat(F.lit(tic), k.cast("string")).alias("tic"), code.alias("sic"), F.lit(first).alias("year1"), F.lit(last).alias("year2"))

    names = name("T", sic, 1990, 1997, F.lit(True)).unionByName(name("U", ((k * 31 + 500) % 10000).cast("string"), 1997, 2010, k % 10 != 0))
    names = names.unionByName(name("V", F.lit(None).cast("string"), 2000, 2012, k % 6 == 0))
    sector = F.when(k % 17 != 0, ((k % 11) * 5 + 10).cast("string"))
    company = s.select("gvkey", sector.alias("gsector"), F.concat(sector, F.lit("10")).alias("ggroup"), F.concat(sector, F.lit("1010")).alias("gind"), F.concat(sector, F.lit("101020")).alias("gsubind"), F.when(k % 8 == 0, F.lit(date(2000, 12, 31))).alias("dldte"))
    return {"members": members, "months": months, "names": names, "company": company}


def panel_sources(spark: SparkSession, sf_dir: str, config: EngineConfig = CONFIG) -> dict[str, DataFrame]:
    """All that ``build_panel`` takes."""
    equity = raw.load_panel_sources(raw_tables(spark, sf_dir), INDEX, config.start_date, config.end_date, spark)
    ranges = ff12_table(spark).withColumnsRenamed({"ff12_num": "industry_num", "ff12_code": "industry_code", "ff12_name": "industry_name"})
    ff5 = factors(spark, sf_dir).withColumn("rf", F.lit(RISK_FREE))
    return equity | {"ff5": ff5, "ff12_def": ranges, "macro": raw.load_macro_sources(macro_daily(spark, sf_dir), config.start_date, config.end_date)}
