"""Shared helpers: table access, written intermediate tables, text batches and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quorumlake.sources.tables import shared_dir

#: Bytes of text that a vectorised kernel takes at once, and rows of text that are held as Python objects: a worker's
#: arrays stay at some tens of MB (a longer text is taken alone).
CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 1000


#: Stands for a null id inside operators: it is the smallest.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables that are written before the driver lets go of finished plans once.
RELEASE_EACH = 3
_writes = 0


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    global _writes
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    _writes += 1
    if _writes % RELEASE_EACH == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, **totals: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and aggregates of its rows (``rows``: their number), taken while they are written: no further job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in totals.items())), label)
    return out, seen.get


def spare(columns: list[str], stem: str) -> str:
    """``stem``, with underscores added until no name of ``columns`` begins with it: for columns beside a user's own."""
    while any(c.lower().startswith(stem.lower()) for c in columns):
        stem += "_"
    return stem


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A long for each of ``n`` partitions that hash partitioning sends there, so that ranges dealt by these keys don't
    share tasks."""
    rows = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in rows}
    return [found.get(p, p) for p in range(n)]


def text_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` that hold about ``limit`` bytes together (one text at least)."""
    a, held = 0, 0
    for b, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield a, b
            a, held = b, 0
        held += len(text) + 1
    if a < len(texts):
        yield a, len(texts)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse: prefix sums of bytes times powers give any substring's
    polynomial hash in a few operations."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base = base | 1
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            steps = np.full(size, self.base, np.uint64), np.full(size, pow(self.base, -1, 1 << 64), np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = np.cumprod(steps[0]), np.cumprod(steps[1])
        return self.up[:n], self.down[:n]

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of uint8 ``data``, one longer than it."""
        up, _ = self.to(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return total

    def hashes(self, total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of each [start, stop), wherever in the data the substring stands."""
        _, down = self.to(len(total))
        return mix64((total[stop] - total[start]) * down[start])


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of plans that are done with: it does once their objects are
    collected, which the driver's heap alone may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Removes the files of a written table that nothing needs any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows of a small intermediate table that go to one file.
FILE_ROWS = 200_000


def files_for(rows: int) -> int:
    """Files for a table of about so many short rows: more as it grows, one where it is small."""
    return max(1, -(-rows // FILE_ROWS))


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable along ``edges`` (u, v), for each node that has an edge.

    Alternates large-star and small-star steps (each a partial-aggregated minimum and a join), so that a hub of any
    degree is never gathered into one row. Every round is written to the shared folder in place of the one before; only
    a count and a checksum of its edges reach the driver, and the rounds end when they stay. An empty edge table gives
    an empty result.
    """
    stamp = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    e, before = counted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label, stamp=stamp)
    files = files_for(before["rows"])
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, now = counted(hung.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(files), label, stamp=stamp)
        dropped(e)
        if now == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(new.select("v", "v").distinct())
        e, before = new, now
