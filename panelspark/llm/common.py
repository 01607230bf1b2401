"""Shared steps of the training-data operators: lineage cuts and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A private folder stands in only where the session names none and runs on
    one machine, as in tests; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there: a lost executor costs one read, not a recompute.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextmanager
def arrow_rows(n: int):
    """Jobs in here, or in a function so decorated, pass ``n`` rows a batch to Python.

    Texts and sets are long rows: a default batch of 10,000 is held by the JVM and
    by the worker at once.
    """
    spark, name = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(n, int(before)) if int(before) > 0 else n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@lru_cache(maxsize=1)
def _libc():
    """The C library, if its allocator can give memory back when told; else None.

    Its thresholds stay as they are: arrays of a few MB mapped one by one
    nearly double the CPU time of sampling.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim(0)
        return libc
    except (OSError, AttributeError):
        return None


def lean(run):
    """``run`` over Arrow batches by a worker that returns what it frees to the system.

    Workers serve one task after another and live on between stages. What their
    allocators keep counts against the executor although nothing holds it.
    """

    @wraps(run)
    def served(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        libc = _libc()
        try:
            yield from run(batches)
        finally:
            if libc:
                libc.malloc_trim(0)

    return served


def discard(*dfs: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and nothing reads again."""
    for df in dfs:
        path = getattr(df, "_cut_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(jpath, True)


#: Tables of keys up to this size are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df``, of rows of ``row_bytes`` at most, marked for broadcast if its counted size allows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Alternating large-star and small-star rewiring: each round is two grouped
    minima and two joins, every one over edges only, and the edge set never
    grows, until a round changes nothing. Returns ``(id, component)`` with the least reachable id for each id
    that has an edge; self-loops are ignored.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = cut(pairs.distinct())
    state = _digest(now)
    while state[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = cut(small)
        discard(now, large)
        before, state, now = state, _digest(new), new
        if state == before:
            break
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return stars.union(roots)


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return int(row[0]), int(row[1])
