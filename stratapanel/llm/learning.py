"""Bounded samples of labelled rows, and what the small numpy models share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType


def bucket(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts))


def text_sample(docs: DataFrame, rows: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """The whole texts of ``rows`` (``id``, ``label``; at most a few thousand) up to ``max_bytes`` in all.

    Rows come in the order of a hash of the id. A text that doesn't fit any more is passed over, so the driver never holds more than
    ``max_bytes`` of text and one entry for each row of ``rows``. Null texts are left out; of rows with one id and label the
    shortest text counts, of equally long ones that of the least hash, and copies count once.
    """
    size, key = F.octet_length("text").alias("size"), F.xxhash64("text").alias("key")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    sized = texts.join(F.broadcast(rows), "id").groupBy("id", "label").agg(F.min(F.struct(size, key)).alias("least")).select("id", "label", "least.*").toPandas()
    sized["rank"] = sized["id"].map(hash_of)
    sized = sized.sort_values(["rank", "size", "label"])
    left, chosen = max_bytes, []
    for at, n in zip(sized.index, sized["size"], strict=True):
        if n <= left:
            chosen.append(at)
            left -= n
    kept = sized.loc[chosen, ["id", "label", "size", "key"]]
    if kept.empty:
        return pa.table({"id": [], "label": [], "text": []})
    schema = rows.select("id", "label").schema.add("size", IntegerType()).add("key", LongType())
    small = F.broadcast(docs.sparkSession.createDataFrame(kept, schema))
    found = texts.select("id", "text", size, key).join(small, ["id", "size", "key"]).groupBy("id", "label", "size", "key").agg(F.first("text").alias("text"))
    out = found.select("id", "label", "text").toArrow()
    order = sorted(range(len(out)), key=lambda k: (hash_of(ids[k]), labels[k])) if (ids := out.column("id").to_pylist()) and (labels := out.column("label").to_pylist()) else []
    return out.take(pa.array(order, pa.int64()))


def hash_of(x: object) -> int:
    """A number in 0 .. 2**32 - 1 that depends on the text of ``x`` alone."""
    import zlib

    return zlib.crc32(f"order {x}".encode())


def first_by_hash(rows: DataFrame, n: int, per: str | None = None) -> DataFrame:
    """``n`` distinct rows (id, label), or ``n`` for each value of ``per``, that come first in a hash order of ``id``; ties go by label.

    All but about the first 2 n ids (of a value) are left out by their hash where they are read, as the number of different ids is known well enough;
    only the rest is shuffled, made distinct and ranked. ``rows`` is evaluated twice.
    """
    key = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40))
    ids = F.greatest(F.approx_count_distinct("id"), F.lit(1))
    share = (2 * n + 100) * float(1 << 40)
    if per is None:
        near = rows.where(key < F.lit(share / rows.agg(ids).first()[0])).select("id", "label").distinct()
        return near.orderBy(key, "label").limit(n)
    near = rows.join(rows.groupBy(per).agg((share / ids).alias("bar")), per).where(key < F.col("bar")).select("id", "label").distinct()
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(key, "label")))
    return ranked.where(F.col("rank") <= n).select("id", "label")


class Adam:
    """Adam over a list of arrays, which it changes in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float = 0.01):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
