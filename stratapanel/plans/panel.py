"""The master panel from its sources: a row for each member and month, with what was known of it then."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.columns import lookup
from ..operators.expand import expand_spans
from ..operators.joins import assert_unique, point_in_time, range_lookup

#: Codes and names of the eleven sectors.
SECTOR_NAMES = {
    "10": "Energy",
    "15": "Materials",
    "20": "Industrials",
    "25": "Consumer Discretionary",
    "30": "Consumer Staples",
    "35": "Health Care",
    "40": "Financials",
    "45": "Information Technology",
    "50": "Communication Services",
    "55": "Utilities",
    "60": "Real Estate",
}
INDUSTRY = ("ff12_num", "ff12_code", "ff12_name")
#: the industry of codes in no range
OTHER = dict(zip(INDUSTRY, (12, "Other", "Other"), strict=True))


def with_industry(rows: DataFrame, ranges: DataFrame, sic: str = "siccd") -> DataFrame:
    """The twelve-industry number, code and name of each SIC code; ``ranges`` as ``parse_range_list`` gives them."""
    named = ranges.select(*[F.col(f"industry_{n}").alias(c) for n, c in zip(("num", "code", "name"), INDUSTRY, strict=True)], "sic_lo", "sic_hi", "ord")
    return range_lookup(rows, sic, named, "sic_lo", "sic_hi", "ord", list(INDUSTRY), OTHER)


def build_panel(sources: Mapping[str, DataFrame], config: EngineConfig, check: bool = False) -> DataFrame:
    """A row for each member and month between the configured dates.

    ``sources``: ``members`` (permno, start, end_date), ``sic_history``, ``gics``, ``monthly`` (permno, date_eom, ret_total, mktcap), ``stocknames_latest``,
    ``ff5`` (factors and rf by month), ``ff12_def`` (ranges) and ``macro`` (by month). Codes are those whose span holds at the month's
    end. What a source doesn't know is null; no member's month is lost. With ``check`` a repeated month of returns is an error, else it
    repeats the panel's row. Factors and macro values have a row a month, so they are small enough to broadcast.
    """
    keys = expand_spans(sources["members"], ["permno"], "start", "end_date", config.start_date, config.end_date)
    coded = point_in_time(keys, sources["sic_history"], "permno", "date_eom", "namedt", "nameenddt", ["siccd"])
    coded = point_in_time(coded, sources["gics"], "permno", "date_eom", "linkdt", "linkenddt", ["gsector"])
    coded = with_industry(coded, sources["ff12_def"]).withColumn("gics_sector_name", lookup(SECTOR_NAMES, F.col("gsector")))
    monthly = sources["monthly"].select("permno", "date_eom", F.col("ret_total").alias("ret"), "mktcap")
    rows = coded.join(assert_unique(monthly, ["permno", "date_eom"]) if check else monthly, ["permno", "date_eom"], "left")
    rows = rows.join(F.broadcast(sources["ff5"]), "date_eom", "left").withColumn("ret_excess", F.col("ret") - F.col("rf"))
    rows = rows.join(F.broadcast(sources["macro"]), "date_eom", "left")
    return rows.join(sources["stocknames_latest"], "permno", "left")
