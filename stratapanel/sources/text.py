"""Parsers of sectioned CSV, two-level range lists and daily series, as DataFrame expressions.

Files are small reference tables; each is read as one row and split, so a line's place is known.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NA_TOKENS = ("", ".", "NA")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``pos`` (from 0) and ``line`` of each line of the text files at ``path``."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def parse_factor_csv(text: DataFrame) -> DataFrame:
    """Monthly factors, as fractions, from ``lines`` of a file with a preamble, a header with ``Mkt-RF``, a monthly block and others.

    The block ends at the first line after the header whose first token isn't six digits.
    """
    by_file = Window.partitionBy("file")
    is_month = F.col("line").rlike(r"^\s*[0-9]{6}\s*(,|$)")
    head = F.min(F.when(F.col("line").contains("Mkt-RF"), F.col("pos"))).over(by_file)
    body = text.withColumn("head", head).where("pos > head")
    stop = F.min(F.when(~is_month, F.col("pos"))).over(by_file)
    parts = F.split("line", ",")
    names = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")
    values = [(F.expr(f"try_cast(trim(get(parts, {k + 1})) AS double)") / 100).alias(n) for k, n in enumerate(names)]
    kept = body.withColumn("stop", stop).where("stop is null or pos < stop").withColumn("parts", parts)
    month = F.try_to_date(F.concat(F.trim(F.get("parts", F.lit(0))), F.lit("01")), "yyyyMMdd")
    return kept.select(F.last_day(month).alias("date_eom"), *values).where("date_eom is not null")


def parse_range_list(text: DataFrame) -> DataFrame:
    """industry_num, industry_code, industry_name, sic_lo and sic_hi from ``lines`` of numbered headers and the ranges below them.

    A line is tried as a range before it is tried as a header. ``ord`` is a range's place in the file.
    """
    span, header = r"^\s*([0-9]{4})-([0-9]{4})", r"^\s*([0-9]+)\s+([A-Za-z]+)\s+(.*)$"
    is_span = F.col("line").rlike(span)
    found = F.when(
        ~is_span & F.col("line").rlike(header),
        F.struct(
            F.regexp_extract("line", header, 1).cast("int").alias("num"), F.regexp_extract("line", header, 2).alias("code"), F.trim(F.regexp_extract("line", header, 3)).alias("name")
        ),
    )
    above = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        text.withColumn("head", F.last(found, ignorenulls=True).over(above))
        .where(is_span)
        .select(
            F.col("head.num").alias("industry_num"),
            F.col("head.code").alias("industry_code"),
            F.col("head.name").alias("industry_name"),
            F.regexp_extract("line", span, 1).cast("int").alias("sic_lo"),
            F.regexp_extract("line", span, 2).cast("int").alias("sic_hi"),
            F.col("pos").alias("ord"),
        )
    )


def parse_series(raw: DataFrame) -> DataFrame:
    """``date`` and ``value`` from two columns of text; the tokens of NA_TOKENS, and what is no number, are null values."""
    value = F.trim("value")
    return raw.select(F.expr("try_cast(date AS date)").alias("date"), F.when(~value.isin(*NA_TOKENS), F.expr("try_cast(trim(value) AS double)")).alias("value"))


def series_lines(text: DataFrame) -> DataFrame:
    """``parse_series`` of the ``lines`` of a two-column CSV with a header."""
    parts = F.split("line", ",")
    body = text.where((F.col("pos") > 0) & (F.trim("line") != "")).select(F.get(parts, F.lit(0)).alias("date"), F.get(parts, F.lit(1)).alias("value"))
    return parse_series(body)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """``parse_series`` of a two-column CSV file with a header."""
    return parse_series(spark.read.csv(path, header=True, schema="date string, value string", nullValue="\0", emptyValue=""))


def series_url(base: str, series_id: str) -> str:
    return f"{base}?id={series_id}"


def read_zipped(spark: SparkSession, archive: str, member: str) -> DataFrame:
    """``lines`` of a text member of ZIP archives, which are read by Spark from any store it knows; nothing is unpacked to a disk.

    ``member`` is matched without its folders. Meant for reference files: an archive's bytes are held by one task.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    for name in packed.namelist():
                        if name.rsplit("/", 1)[-1] == member:
                            rows = packed.read(name).decode("utf-8", "replace").splitlines()
                            yield pa.RecordBatch.from_arrays([pa.array([f"{path}!{name}"] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.string())], ["file", "pos", "line"])

    return spark.read.format("binaryFile").load(archive).select("path", "content").mapInArrow(unpack, "file string, pos int, line string")
