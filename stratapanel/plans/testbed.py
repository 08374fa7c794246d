"""The star-schema test tables seen as a monthly panel: suppliers are the entities, their shipments' prices the returns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.joins import range_lookup
from ..sources.cache import checkpointed

RISK_FREE = 0.001
#: the testbed's months run from 1995 to 2001
CONFIG = EngineConfig(
    start_date=date(1995, 1, 1),
    end_date=date(2001, 11, 30),
    train_start=date(1998, 1, 1),
    train_end=date(1999, 12, 31),
    test_start=date(2000, 1, 1),
    test_end=date(2001, 11, 30),
    refit_window_months=48,
)

#: The twelve-industry classification of SIC codes, (number, code, name, low, high); codes in no range are number 12.
FF12_RANGES = [
    (1, "NoDur", "Consumer Nondurables", 100, 999), (1, "NoDur", "Consumer Nondurables", 2000, 2399), (1, "NoDur", "Consumer Nondurables", 2700, 2749),
    (1, "NoDur", "Consumer Nondurables", 2770, 2799), (1, "NoDur", "Consumer Nondurables", 3100, 3199), (1, "NoDur", "Consumer Nondurables", 3940, 3989),
    (2, "Durbl", "Consumer Durables", 2500, 2519), (2, "Durbl", "Consumer Durables", 2590, 2599), (2, "Durbl", "Consumer Durables", 3630, 3659),
    (2, "Durbl", "Consumer Durables", 3710, 3711), (2, "Durbl", "Consumer Durables", 3714, 3714), (2, "Durbl", "Consumer Durables", 3716, 3716),
    (2, "Durbl", "Consumer Durables", 3750, 3751), (2, "Durbl", "Consumer Durables", 3792, 3792), (2, "Durbl", "Consumer Durables", 3900, 3939),
    (2, "Durbl", "Consumer Durables", 3990, 3999), (3, "Manuf", "Manufacturing", 2520, 2589), (3, "Manuf", "Manufacturing", 2600, 2699),
    (3, "Manuf", "Manufacturing", 2750, 2769), (3, "Manuf", "Manufacturing", 3000, 3099), (3, "Manuf", "Manufacturing", 3200, 3569),
    (3, "Manuf", "Manufacturing", 3580, 3629), (3, "Manuf", "Manufacturing", 3700, 3709), (3, "Manuf", "Manufacturing", 3712, 3713),
    (3, "Manuf", "Manufacturing", 3715, 3715), (3, "Manuf", "Manufacturing", 3717, 3749), (3, "Manuf", "Manufacturing", 3752, 3791),
    (3, "Manuf", "Manufacturing", 3793, 3799), (3, "Manuf", "Manufacturing", 3830, 3839), (3, "Manuf", "Manufacturing", 3860, 3899),
    (4, "Enrgy", "Energy", 1200, 1399), (4, "Enrgy", "Energy", 2900, 2999), (5, "Chems", "Chemicals", 2800, 2829), (5, "Chems", "Chemicals", 2840, 2899),
    (6, "BusEq", "Business Equipment", 3570, 3579), (6, "BusEq", "Business Equipment", 3660, 3692), (6, "BusEq", "Business Equipment", 3694, 3699),
    (6, "BusEq", "Business Equipment", 3810, 3829), (6, "BusEq", "Business Equipment", 7370, 7379), (7, "Telcm", "Telecommunication", 4800, 4899),
    (8, "Utils", "Utilities", 4900, 4949), (9, "Shops", "Wholesale and Retail", 5000, 5999), (9, "Shops", "Wholesale and Retail", 7200, 7299),
    (9, "Shops", "Wholesale and Retail", 7600, 7699), (10, "Hlth", "Healthcare", 2830, 2839), (10, "Hlth", "Healthcare", 3693, 3693),
    (10, "Hlth", "Healthcare", 3840, 3859), (10, "Hlth", "Healthcare", 8000, 8099), (11, "Money", "Finance", 6000, 6999),
]
OTHER = {"ff12_num": 12, "ff12_code": "Other", "ff12_name": "Other"}
INDUSTRY_CODES = [*dict.fromkeys(r[1] for r in FF12_RANGES), "Other"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ff12_table(spark: SparkSession) -> DataFrame:
    rows = [(*r, k) for k, r in enumerate(FF12_RANGES)]
    return spark.createDataFrame(rows, "ff12_num int, ff12_code string, ff12_name string, sic_lo int, sic_hi int, ord int")


def with_industry(rows: DataFrame, sic: str = "siccd") -> DataFrame:
    return range_lookup(rows, sic, ff12_table(rows.sparkSession), "sic_lo", "sic_hi", "ord", ["ff12_num", "ff12_code", "ff12_name"], OTHER)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno, date_eom, prc, shrout, mktcap: one shuffle with partial sums."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    by_month = items.groupBy(F.col("l_suppkey").alias("permno"), F.last_day(F.to_date("l_shipdate")).alias("date_eom"))
    sums = by_month.agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("prc"), F.sum("l_quantity").alias("shrout"))
    return sums.withColumn("mktcap", F.abs("prc") * F.col("shrout"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("permno").orderBy("date_eom")
    return prices(spark, sf_dir).withColumns({"ret": F.col("prc") / F.lag("prc").over(w) - 1, "mc_lag": F.lag("mktcap").over(w)})


def factors(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    """Five factor returns a month: differences of mean returns between halves of the suppliers. ``months`` are the returns, if they are at hand."""
    months = checkpointed(returns(spark, sf_dir)) if months is None else months
    rows = months.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("permno"), "s_nationkey", "s_acctbal"), "permno")
    middle = rows.groupBy("date_eom").agg(F.median("mc_lag").alias("mc_mid"), F.median("s_acctbal").alias("acct_mid"))
    rows = rows.join(middle, "date_eom").withColumns({
        "small": F.coalesce(F.col("mc_lag") < F.col("mc_mid"), F.lit(False)),
        "rich": F.coalesce(F.col("s_acctbal") > F.col("acct_mid"), F.lit(False)),
    })

    def spread(flag):
        return F.avg(F.when(flag, F.col("ret"))) - F.avg(F.when(~flag, F.col("ret")))

    return rows.groupBy("date_eom").agg(
        F.avg("ret").alias("mkt_rf"), spread(F.col("small")).alias("smb"), spread(F.col("s_nationkey") % 2 == 0).alias("hml"), spread(F.col("permno") % 3 == 0).alias("rmw"), spread(F.col("rich")).alias("cma")
    )


def macro_daily(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three daily series from the orders, one for each status or priority."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    first = F.substring("o_orderpriority", 1, 1)
    pick = {"ten_y": first == "1", "ffr": first == "2", "vix": F.lit(True)}
    return {n: orders.where(c).groupBy("date").agg(F.avg("o_totalprice").alias("value")) for n, c in pick.items()}


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno, gsector (number), gics_sector_name and ticker of each supplier: its region and name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("permno"), F.col("r_regionkey").cast("string").alias("gsector"), F.col("r_name").alias("gics_sector_name"), F.col("s_name").alias("ticker"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master panel: returns, factors, industry, sector and macro values of each supplier and month. Monthly returns are written once, for the
    panel and its factors; tables of one row a month are small enough to broadcast."""
    from ..sources.raw import macro_table

    months = checkpointed(returns(spark, sf_dir))
    rows = with_industry(months.drop("mc_lag").withColumn("siccd", (F.col("permno") * 97 % 10000).cast("int"))).join(sectors(spark, sf_dir), "permno", "left")
    rows = rows.join(F.broadcast(factors(spark, sf_dir, months)), "date_eom", "left").withColumn("rf", F.lit(RISK_FREE))
    rows = rows.withColumn("ret_excess", F.col("ret") - F.col("rf"))
    return rows.join(F.broadcast(macro_table(macro_daily(spark, sf_dir))), "date_eom", "left")
