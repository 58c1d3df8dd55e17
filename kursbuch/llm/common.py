"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests, one machine), a temporary folder is made once
    and recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="kursbuch-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kursbuch-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kursbuch_folder = path
    return out


def release(*staged: DataFrame) -> None:
    """Removes the files of staged tables that nothing will read again."""
    for df in staged:
        spark, folder = df.sparkSession, getattr(df, "_kursbuch_folder", None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


T = TypeVar("T")
_resident: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], T]) -> T:
    """The one large object that a Python worker keeps from task to task.

    Workers are used again by later stages: whoever asks for another object drops the one that an earlier
    operator left, so a chain of operators needs no more memory than the largest of them."""
    if key not in _resident:
        if _resident:
            _resident.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _resident[key] = make()
    return _resident[key]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, salts: int = 64) -> DataFrame:
    """Left join of a small-rowed right side, unique on keys, whose keys may be hot in left.

    The right side is repeated once for each salt and left rows choose their salt by
    ``spread`` (a deterministic hash of something other than the keys), so a key with a
    third of all rows lands in ``salts`` tasks, not one. Null keys equal each other.
    """
    a, b = fresh(left, "_salt"), fresh(right, "_salt_r")
    lk = left.withColumn(a, F.pmod(spread, F.lit(salts)).cast("int"))
    rk = right.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names = {k: fresh(lk, f"_r_{k}") for k in keys}
    for k, n in names.items():
        rk = rk.withColumnRenamed(k, n)
    on = F.col(a) == F.col(b)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return lk.join(rk, on, "left").drop(a, b, *names.values())
