"""What the corpus operators share: table access, the shared folder, identifiers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only in a local session where ``spark.checkpoint.dir`` is unset (tests) a temporary folder is chosen and put into the
    session, so that later calls agree on it; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lectern-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: By operator, how a Python worker forgets what that operator's tasks left in it.
_left: dict[str, Callable[[], None]] = {}


def only(operator: str, forget: Callable[[], None] = lambda: None) -> None:
    """At a task's beginning: the worker, which tasks of all operators share, forgets what those of others left in it."""
    for other in [o for o in _left if o != operator]:
        _left.pop(other)()
    _left[operator] = forget
    pa.default_memory_pool().release_unused()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` agrees with that unless the text has a cased letter beyond ASCII; only such texts take the slower ``translate``.
    """
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
