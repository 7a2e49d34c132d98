"""What the corpus operators share: the shared folder, stored tables, text rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Only a local session may go without it; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="helixloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before us
            return


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared folder, deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/helixloom/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    # Executors delete a shuffle's files only when the driver has collected the plan that made them.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._helixloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_helixloom_path", None):
            _delete(df.sparkSession, path)
            _written.pop(path, None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the order of rows without an id begins.
NO_ID = 1 << 62


def order_of(doc_id: Column, text: Column) -> Column:
    """The id; for rows without one a number from NO_ID on, by the text's hash, so that they come after all ids below it."""
    return F.coalesce(doc_id, F.xxhash64(F.lit("no id"), text).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def word_count(text: Column) -> Column:
    """Words are maximal runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
