"""A table in revisions: written beside the others, and published only if nothing was since it was read.

The folder holds the rows of each revision in a folder of their own and a manifest for each, named by its
number. A writer says which revision it has read; its manifest is written under another name and then moved
to the next number, which the file system does for one writer alone. A reader takes the last manifest, so it sees
the whole of one revision; a stale writer's rows are deleted again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_revisions"


class StaleRevision(Exception):
    """Another revision was published since the expected one."""


def files(spark: SparkSession, path: str):
    """Hadoop's path factory, a context that can move without replacing, and the file system of a path."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    root = of(path)
    system = root.getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    return of, context, system


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The published revisions, ascending."""
    of, _, system = files(spark, path)
    folder = of(f"{path}/{MANIFESTS}")
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, revision: int) -> dict:
    line = spark.read.text(f"{path}/{MANIFESTS}/{revision:012d}.json").first()
    return json.loads(line[0])


def current(spark: SparkSession, path: str) -> int:
    """The last revision; 0 before the first."""
    return max(numbers(spark, path), default=0)


def read(spark: SparkSession, path: str, revision: int | None = None) -> DataFrame:
    """The rows of a revision, the last one by default."""
    revision = current(spark, path) if revision is None else revision
    if not revision:
        raise ValueError(f"nothing is published in {path}")
    return spark.read.parquet(f"{path}/{manifest(spark, path, revision)['rows']}")


def publish(table: DataFrame, path: str, expected: int, note: str = "") -> int:
    """Publish the table as the revision after ``expected`` and return its number.

    Raises StaleRevision if that one is not the last any more, before the rows are written or after. A job that fails leaves no revision.
    """
    spark = table.sparkSession
    of, context, system = files(spark, path)
    if current(spark, path) != expected:
        raise StaleRevision(f"revision {expected} of {path} is not the last one")
    own = uuid.uuid4().hex
    rows = f"rows-{own}"
    table.write.parquet(f"{path}/{rows}")
    system.mkdirs(of(f"{path}/{MANIFESTS}"))
    draft, place = of(f"{path}/{MANIFESTS}/.{own}.draft"), of(f"{path}/{MANIFESTS}/{expected + 1:012d}.json")
    out = system.create(draft, False)
    out.write((json.dumps({"revision": expected + 1, "rows": rows, "note": note}) + "\n").encode())
    out.close()
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    try:
        if current(spark, path) != expected:
            raise StaleRevision(f"revision {expected} of {path} is not the last one")
        context.rename(draft, place, options)
    except (StaleRevision, Py4JJavaError) as error:
        system.delete(draft, False)
        system.delete(of(f"{path}/{rows}"), True)
        if isinstance(error, StaleRevision) or "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise StaleRevision(f"revision {expected + 1} of {path} was published meanwhile") from error
        raise
    return expected + 1


def updated(spark: SparkSession, path: str, change, attempts: int = 5, note: str = "") -> int:
    """Publish what ``change`` makes of the last revision; if another writer was first, of that one's rows again."""
    for _ in range(attempts):
        expected = current(spark, path)
        try:
            return publish(change(read(spark, path, expected)), path, expected, note)
        except StaleRevision:
            continue
    raise StaleRevision(f"{path} changes too often")
