"""What the operators of this subpackage share: Arrow batches in bounded parts, and rows told apart.

Tables that several jobs read are written to the cluster's shared folder (``tessera.sources.scratch``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import scratch
from tessera.sources.scratch import let_go, release, scratch_tables

__all__ = ["columns_of", "cut", "free", "held_out", "id_and_text", "let_go", "numbered", "release", "scratch_tables", "slices"]

#: Bytes of text that a worker takes from an Arrow batch at once; what it makes of them is a few times as large.
SLICE_BYTES = 2 << 20
#: Rows that it takes at once at most.
SLICE_ROWS = 500
#: What an Arrow batch holds while ``cut`` writes; results that are written elsewhere follow the session's own setting.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``scratch.cut`` with small Arrow batches; the session's setting is as before afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH[0])
    conf.set(*BATCH)
    try:
        return scratch.cut(df, name, keep)
    finally:
        conf.set(BATCH[0], before)


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of bounded bytes of the text column (a longer text is a part by itself)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and (total + size > SLICE_BYTES or k - start >= SLICE_ROWS):
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has: this one, or with underscores behind it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column ``name`` (a free one) that tells every row from all others, the same whenever it is read.

    It is made of the file and the place in it; rows that are no files' rows are written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs, "numbered")
    meta, file, index, path, start = docs.metadataColumn("_metadata"), *(free(docs, n) for n in ("file", "index", "path", "start"))
    files = sorted((r[0] for r in docs.select(meta["file_path"]).distinct().collect()), key=lambda f: (len(f), f))
    places = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"{path} string, {start} long")
    rows = docs.select(*columns_of(docs), meta["file_path"].alias(file), meta["row_index"].alias(index))
    return rows.join(F.broadcast(places), F.col(file) == F.col(path)).select(*columns_of(docs), (F.col(start) + F.col(index)).alias(name))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): a null text is empty, and no other column can clash with a result's."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id"):
    """The rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
