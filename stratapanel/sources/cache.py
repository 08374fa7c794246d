"""Parquet tables, the compute-or-load cache, listings and empty relations."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

log = logging.getLogger("stratapanel")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A parquet table; with ``schema`` its columns and types are enforced rather than inferred."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a complete table; asked of the path's own file system."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cached_table(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, computed and written first where it is missing or ``force`` is set."""
    if force or not exists(spark, path):
        write_table(compute(), path)
        log.info("wrote %s", path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; where it is unset, a temporary one if all runs on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratapanel-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there: later plans start short and read the columns they need,
    and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/panel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_table(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path`` and ``length`` of the files that match; their contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def jdbc_options(host: str, database: str, user: str, password: str, port: int = 5432, ssl: bool = True) -> dict[str, str]:
    """Options of a PostgreSQL source."""
    url = f"jdbc:postgresql://{host}:{port}/{database}" + ("?sslmode=require" if ssl else "")
    return {"url": url, "user": user, "password": password, "driver": "org.postgresql.Driver"}


def jdbc_table(spark: SparkSession, options: Mapping[str, str], table: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A lazy remote table: filters and projections are pushed down. ``partition`` is (column, low, high, parts)."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def jdbc_query(spark: SparkSession, options: Mapping[str, str], sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).option("query", sql).load()


def sql_on(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str, **args: object) -> DataFrame:
    """A parameterised statement (``:name``) over the given relations, which are placeholders ``{name}`` in it."""
    return spark.sql(sql, args=args or None, **tables)
