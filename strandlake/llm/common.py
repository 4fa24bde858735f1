"""What the operators share: tables, the shared scratch folder, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; its folder may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session, and only where that is unset in local mode (tests) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or f"file://{tempfile.gettempdir()}/strandlake-scratch"


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """From now on Arrow batches to Python hold at most so many bytes, or one row,
    if the session's bound is larger: 10,000 long texts are no small batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= most_bytes:
        spark.conf.set(name, str(most_bytes))


_held: dict = {}


def held(key, make):
    """What ``make`` gives, made once per Python worker, for the tasks of stages that are ``lean(holds=True)``."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops what is held, for a stage that doesn't need it."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Returns free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(stage=None, *, holds: bool = False):
    """A function of Arrow batches that gives its memory back to the system when its task ends.

    Spark's Python workers live on; what one task's tables took would otherwise stay with
    the worker while later stages need memory of their own. So does what ``held`` keeps,
    which goes when a stage begins that isn't said to hold such things.
    """
    if stage is None:
        return functools.partial(lean, holds=holds)

    @functools.wraps(stage)
    def run(*args, **options):
        if not holds:
            let_go()
        try:
            yield from stage(*args, **options)
        finally:
            give_back()

    return run


#: Rows of a written table that a join sends to all executors, at most.
BROADCAST_ROWS = 500_000


def joinable(written: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few columns, to be joined with texts: broadcast if it has few rows, so that the texts stay where they are.

    Spark itself goes by compressed bytes, or shuffles the texts before it knows the rows.
    """
    return F.broadcast(written) if written.count() <= most else written.hint("merge")


class Scratch:
    """Intermediate tables and files of one call, in the shared folder.

    ``keep`` writes a table and reads it back, which cuts its lineage: a lost
    executor costs the tasks that ran there, not the stages before the table.
    Folders are removed by ``drop`` or, as results are lazy, when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.held: dict[str, str] = {}
        small_batches(spark)
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.free()  # what came before is out of reach only now
        self.held[name] = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(self.held[name], compression=codec)
        kept = self.spark.read.schema(df.schema).parquet(self.held[name])
        self.free()
        return kept

    def free(self) -> None:
        """Lets Spark delete the shuffle files of what is no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.held.pop(name) if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
