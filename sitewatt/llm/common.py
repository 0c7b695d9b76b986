"""Helpers shared by the operators: written intermediate tables, digests."""

from __future__ import annotations

import contextvars
import functools
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from sitewatt.session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


#: Folders written by the pipeline stage that is running, and what each application's last stage left.
_own: contextvars.ContextVar = contextvars.ContextVar("stage_tables", default=None)
_left: dict[str, set[str]] = {}


def pipeline_stage(fn):
    """A stage ``(spark, docs, sf_dir)`` whose intermediate tables go when the next stage starts.

    By then a stage's result has been written and is the next one's ``docs``; tables
    that ``docs`` itself reads stay.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        name = lambda folder: folder.rsplit("/", 1)[1]
        read = set(map(name, tables_of(docs)))
        drop_folders(spark, {f for f in _left.pop(app, set()) if name(f) not in read})
        own: set[str] = set()
        token = _own.set(own)
        try:
            return fn(spark, docs, sf_dir)
        finally:
            _own.reset(token)
            _left[app] = own
    return run


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor repeats the reading of files, not the
    work before. The step's shuffle files go when it is written (nothing runs its
    plan again), the rest when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    if _own.get() is not None:
        _own.get().add(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def tables_of(df: DataFrame) -> set[str]:
    """Folders of ``materialize`` that the plan of ``df`` reads."""
    return {p for p in (f.rsplit("/", 1)[0] for f in df.inputFiles()) if p.rsplit("/", 1)[1].startswith("llm-")}


def drop_table(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that no later step reads."""
    drop_folders(df.sparkSession, tables_of(df))


def drop_folders(spark: SparkSession, folders: set[str]) -> None:
    sc = spark.sparkContext
    for f in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
