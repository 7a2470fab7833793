"""What the operators share: input tables, shared intermediate tables, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to Python is worked off in slices of about so many characters.
SLICE_CHARS = 4_000_000
#: Arrow batches of texts are about so large.
BATCH_MB = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine (``local``) a temporary one if none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            where = tempfile.mkdtemp(prefix="tarn-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts the lineage: after the loss of an executor the table is read again,
    not computed again.  The tables are left to whoever owns the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most ``BATCH_MB``, however long they are; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_MB << 20:
        spark.conf.set(key, str(BATCH_MB << 20))


def without(df: DataFrame, results: list[str], text_col: str) -> DataFrame:
    """``df`` without columns that are named like a result (in any case); the column of texts stays."""
    names = {r.lower() for r in results}
    if text_col.lower() in names:
        raise ValueError(f"the column of texts is named like a result: {text_col}")
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in names])


def worker_cache(name: str, build):
    """``build()`` once per Python process, however many tasks it serves."""
    holder = sys.modules.setdefault("tarn_worker_cache", types.ModuleType("tarn_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, build())
    return getattr(holder, name)


def text_slices(texts: list, chars: int = SLICE_CHARS):
    """Ranges ``(lo, hi)`` of rows that hold about ``chars`` characters, one row at least."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def give_back_memory() -> None:
    """Returns what a task freed to the system, since workers live on beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
