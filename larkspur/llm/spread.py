"""How the operators deal rows out: chunks of whole documents, packed key exchanges, tables kept in the shared folder.

`chunked` deals documents to chunks of bounded size by a hash of their id. Numpy code then works on one chunk at a time
(`groupBy(chunk).applyInArrow`), and what chunks have to tell each other goes as packed arrays, one row per chunk and
bucket, so that a key held by a third of all rows costs one entry per chunk. The same exchange serves every step that
asks for it: Spark reuses it within a plan.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


class _Written(threading.local):
    """Tables that kept() has written in this thread, in their order."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()
#: Text bytes of a chunk, and bytes of packed keys that meet in a bucket, about.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, as in tests, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _own.get("at")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own["at"] = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, at, True)
    return at


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    to = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    _written.paths.append(to)
    return spark.read.schema(df.schema).parquet(to)


def written() -> int:
    """How many tables kept() has written in this thread so far."""
    return len(_written.paths)


def remove_written(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables that kept() wrote from the since-th to before the until-th; nothing that is still to run may read them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for to in _written.paths[since:until]:
        path = jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(conf).delete(path, True)


def later_copies(rows: DataFrame, by: list[str], key: str = "doc_id", salts: int = 16) -> DataFrame:
    """Rows whose columns `by` equal those of a row with a smaller key, with that least key. A group of copies is dealt to `salts` parts; the
    groups' least rows, one each, are repeated for them."""
    least = rows.groupBy(*by).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(least, [*by, "salt"]).where(F.col(key) > F.col("least")).drop("salt")


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    got = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(got[0]), int(got[1])


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(total) // each))


def chunked(docs: DataFrame, n: int, key: str = "doc_id", *columns: str) -> DataFrame:
    """chunk and the given columns, dealt by chunk to n partitions."""
    return docs.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("chunk"), key, *columns).repartition(n, "chunk")


def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket, the buckets that occur, and where each starts (one more)."""
    b = ((key >> np.uint64(33)).astype(np.int64) * buckets) >> 31
    order = np.argsort(b, kind="stable")
    got, at = np.unique(b[order], return_index=True)
    return order, got, np.append(at, len(b))


def table(**cols) -> pa.Table:
    return pa.table(cols)


def blobs(parts_: list) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts_], pa.binary())


def joined(col, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All packed arrays of a binary column, one after another, and the count of each."""
    size = np.dtype(dtype).itemsize
    items = [x or b"" for x in col.to_pylist()]
    return np.frombuffer(b"".join(items), dtype), np.array([len(x) // size for x in items], np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """node, component: the smallest node that each node of an edge can reach.

    Rounds of large-star and small-star (Kiveris and others, 2014): each node links its larger neighbours, then itself
    and its smaller neighbours, to the least of them; every round is a Spark aggregation and join over the edges, none
    is gathered on the driver. A node with very many edges costs partial minima only.
    """
    pairs = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = kept(nxt.select("e.u", "e.v").where("u <> v").distinct(), name)
        # stars only: no node is both a centre and a leaf, and no leaf has two centres
        leaves = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if not nxt.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() and not leaves.where("n > 1").limit(1).count():
            break
        pairs = nxt
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def key_bytes(items: int) -> int:
    """Bytes of a hash by which about 1 of 2**16 unlike items among so many meets another: enough for a first sieve."""
    return min(8, max(2, -(-(int(items).bit_length() + 17) // 8)))


def narrow(key: np.ndarray, width: int) -> np.ndarray:
    """The upper `width` bytes of each 64-bit key, the lowest bit cleared for a flag."""
    return (key >> np.uint64(64 - 8 * width)) & ~np.uint64(1)


def narrow_blob(key: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(key, "<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def joined_narrow(col, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As joined(), of keys written by narrow_blob."""
    flat, counts = joined(col, np.uint8)
    out = np.zeros((len(flat) // width, 8), np.uint8)
    out[:, :width] = flat.reshape(-1, width)
    return out.view("<u8").ravel(), counts // width
