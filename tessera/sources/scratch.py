"""Tables that several jobs read, written to the folder that all executors share.

Executors may be lost at any time, so such a table is cut from its lineage by writing it to the
folder that the cluster names in ``spark.checkpoint.dir``, which every executor can read back.
``release`` deletes one once all that was made of it is written too; ``scratch_tables`` deletes
those that are left when its block ends.
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute of a DataFrame that ``cut`` has read back: the folder of its table.
PATH = "_tessera_table"
#: Folders of the tables that the innermost ``scratch_tables`` block owns.
owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


#: Seconds between garbage collections, and when the last one was.
PAUSE = 2.0
collected = {"at": 0.0}
#: Temporary folders of local sessions that name none, by application.
local_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in local_folders:
        local_folders[own] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return local_folders[own]


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back without its lineage; keep it beyond ``scratch_tables``."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    if owned.get() is not None and not keep:
        owned.get().append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    setattr(back, PATH, path)
    return back


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys over all of the session's shuffle partitions, for long work on short rows.

    A table of few bytes comes from few files and row groups, and adaptive execution would join its small partitions again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Spark keeps shuffle files until the driver's garbage collection finds that no plan needs them: now is a good time.

    Steps that follow each other within PAUSE seconds have left little, and wait for the next one.
    """
    if time.monotonic() - collected["at"] >= PAUSE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        collected["at"] = time.monotonic()


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more, and let go of the shuffle files of what has been written."""
    for df in tables:
        delete(df.sparkSession, getattr(df, PATH))
    let_go(tables[0].sparkSession)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables cut within the block at its end: results that read them must be written before."""
    token = owned.set(paths := [])
    try:
        yield
    finally:
        owned.reset(token)
        for path in paths:
            delete(spark, path)


def in_file_order(table: DataFrame, name: str) -> DataFrame:
    """A table of ``cut`` with the place of each row, from 1, in the order of its files and of rows in them.

    After a sort, that is the sorted order. Only the files' row counts meet in one place.
    """
    rows = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    counts = rows.groupBy("__file").agg(F.count("*").alias("n")).collect()  # a row for each file
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: (len(r["__file"]), r["__file"])):
        starts.append((r["__file"], total))
        total += r["n"]
    places = table.sparkSession.createDataFrame(starts, "__file string, __start long")
    return rows.join(F.broadcast(places), "__file").withColumn(name, F.col("__start") + F.col("__index") + 1).drop("__file", "__index", "__start")
