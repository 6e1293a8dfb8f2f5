"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session has none (tests), a folder of the machine is made and set; on a
    cluster that would lose rows silently, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded(f):
    """For functions of a session first: Arrow batches hold BATCH rows at most, as texts can be long.

    Batches are allocated outside the heap, several to a task; Spark's own limit of 10,000 rows
    is some 35 MB of text each.
    """

    @wraps(f)
    def run(spark: SparkSession, *rest):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return f(spark, *rest)

    return run


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: lost executors cost a reread, not the work before it.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def with_fields(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of ``df`` with ``fields`` put in place of, or after, its own."""
    new = {n for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    return T.StructType(kept + [T.StructField(n, t) for n, t in fields])


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` has about ``most`` bytes in each."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        n = batch.num_rows
        step = max(1, int(n * most / max(1, batch.column(at).nbytes)))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``columns`` in place of, or after, its own."""
    kept = [n for n in batch.schema.names if n not in columns]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=kept + list(columns))


def sha256(data: bytes) -> str:
    """Lowercase hex of the digest."""
    return hashlib.sha256(data).hexdigest()


def held_out(doc_id="doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def driver_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return os.path.join(os.path.dirname(public_tokenizers.__file__), name)
