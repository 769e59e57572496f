"""What the operators share: tables, scratch storage on the shared folder, and word rules.

Scratch tables cut lineage: they are Parquet in ``spark.checkpoint.dir``, which driver and executors
share, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java and RE2 syntax: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The columns of ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_scratch: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode without such a setting, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/rasterloom-{label}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _scratch.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for name, spark in _tables.items():
        with contextlib.suppress(Exception):  # the session has ended, its catalog with it
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path, spark in list(_scratch.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; the folder is its owner's to clear
            _scratch.pop(path, None)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand rows to Python in Arrow batches of 4 MB instead of Spark's 64, unless it has its own setting."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, None) in (None, "67108864b"):
        conf.set(key, "4m")
    return df


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, one evaluation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of Parquet in a bucket, and the most buckets (of 100 TB, 5 GB each, read as a stream).
BUCKET_BYTES, BUCKETS = 32 << 20, 20_000


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` as a table on the shared folder, dealt by ``key`` into buckets: joins by ``key`` move their other side alone, whatever the size.

    The rows are written once before they are dealt, so that a repeated task cannot number them anew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    length = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    n = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // BUCKET_BYTES)))
    name, rows = f"rasterloom_{uuid.uuid4().hex}", spark.read.schema(df.schema).parquet(path)
    rows.repartition(n, F.col(key)).write.bucketBy(n, key).option("path", scratch_path(spark, label + "-dealt")).format("parquet").saveAsTable(name)
    _tables[name] = spark
    drop_path(spark, path)
    return spark.table(name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


#: A key of more rows than this is dealt to several tasks, and the most keys that are.
HOT, HOT_KEYS = 256, 2_000


def dealt_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (one row a key; its column n says how many rows of ``rows`` have the key).

    Keys of more than HOT rows are dealt to tasks by ``by``, a column of ``rows``, and their side row goes to each of
    those. At most rows / HOT keys can be so hot, and the bound rises with the table, so that there are never more than HOT_KEYS
    of them: they stand in the plan, by powers of two of their tasks, and the rows of all other keys pass no other join.
    """
    total = side.agg(F.sum("n")).first()[0] or 0
    bound = max(HOT, -(-total // HOT_KEYS))
    hot: dict[int, list[int]] = {}
    for k, n in side.where(F.col("n") > bound).select(key, "n").collect():
        if k is not None:
            hot.setdefault(1 << (-(-n // bound) - 1).bit_length(), []).append(k)
    if not hot:
        return rows.join(side.drop("n"), key, how)
    parts = F.lit(1)
    for n, keys in sorted(hot.items()):
        parts = F.when(F.col(key).isin(sorted(keys)), n).otherwise(parts)
    left = rows.withColumn("__deal", F.pmod(F.xxhash64(by), parts).cast("int"))
    right = side.drop("n").withColumn("__deal", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "__deal"], how).drop("__deal")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (narrow ones), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it (names are compared without case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def heaviest(df: DataFrame, weight: str, rows: int) -> DataFrame:
    """The rows of greatest ``weight`` (1 or more), at most ``rows``: all above a cut between bins of 1/16 octave.

    A histogram of at most 1024 bins finds the cut, so no task or driver ever holds more than the result.
    """
    bin_ = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)).cast("double")) * 16).cast("int")
    found = df.groupBy(bin_.alias("b")).count().collect()
    cut, left = 1 << 30, rows
    for r in sorted(found, key=lambda r: -r["b"]):
        left -= r["count"]
        if left < 0:
            break
        cut = r["b"]
    return df.where(bin_ >= cut)


def hashed_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, the smallest by hash of ``keys`` (then by all columns); a filter cuts the most before."""
    n = df.count()
    h = F.xxhash64(*keys)
    if n > 2 * rows:
        span = 1 << 30
        df = df.where(F.pmod(h, F.lit(span)) < int(span * 1.2 * rows / n) + 1)
        order = F.pmod(h, F.lit(span))
    else:
        order = h
    return df.orderBy(order, *keys).limit(rows)


def trim() -> None:
    """Give memory that earlier tasks of a reused worker have freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A batch function that gives back what it freed when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
