"""Keyed upserts that rewrite only what changed (SNK-2, SNK-3, STR-6 on plain Parquet).

Rows live in key buckets, ``<path>/data/<version folder>/bucket=<b>``. A manifest per
version names the folder of every bucket; it is written to a side name and renamed, last
of all, so readers see a merge entirely or not at all and a failed one leaves the
version before as it was. A merge reads and writes only the buckets that hold a key whose
row changes; a batch that changes nothing writes nothing, so a replay is harmless.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitewatt.operators.latest import latest_per_key

KEEP = 3  # versions whose folders stay for readers that opened them


class KeyedTable:
    """A table with unique keys (a null is a key value) in ``buckets`` hash buckets.

    ``order``: column that decides between rows of a key; a batch row replaces a stored one
    if its order is not smaller (null is smallest). Without it the batch always wins and must
    hold a key once. One writer at a time; a second one's commit of the same version fails.
    """

    def __init__(self, path: str, keys, order: str | None = None, buckets: int = 256):
        self.path, self.keys, self.order, self.buckets = path.rstrip("/"), list(keys), order, buckets

    # -- files ---------------------------------------------------------------
    def _fs(self, spark: SparkSession, path: str):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def _listed(self, spark: SparkSession, sub: str) -> list[str]:
        fs, where = self._fs(spark, f"{self.path}/{sub}")
        return sorted(st.getPath().getName() for st in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed(spark, "manifest") if n[:-5].isdigit() and n.endswith(".json"))

    def manifest(self, spark: SparkSession, version: int | None = None) -> tuple[dict[int, str], StructType | None]:
        """Folder of every bucket that holds rows, and the columns; of the newest version unless one is named."""
        known = self.versions(spark)
        if not known:
            return {}, None
        fs, where = self._fs(spark, f"{self.path}/manifest/{known[-1] if version is None else version}.json")
        stream = fs.open(where)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        stored = json.loads(text)
        return {int(b): folder for b, folder in stored["buckets"].items()}, StructType.fromJson(stored["schema"])

    def _commit(self, spark: SparkSession, version: int, folders: dict[int, str], schema) -> None:
        side = f"{self.path}/manifest/.{version}-{uuid.uuid4().hex}"
        fs, where = self._fs(spark, side)
        out = fs.create(where, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "buckets": folders}).encode()))
        finally:
            out.close()
        _, final = self._fs(spark, f"{self.path}/manifest/{version}.json")
        if fs.exists(final) or not fs.rename(where, final):
            raise RuntimeError(f"version {version} of {self.path} has been written by someone else")

    def _clean(self, spark: SparkSession) -> None:
        known = self.versions(spark)
        used = {f for v in known[-KEEP:] for f in self.manifest(spark, v)[0].values()}
        for v in known[:-KEEP]:
            fs, where = self._fs(spark, f"{self.path}/manifest/{v}.json")
            fs.delete(where, False)
        for name in self._listed(spark, "data"):
            if int(name.split("-")[0]) <= known[-1] and not any(f.startswith(f"{name}/") for f in used):
                fs, where = self._fs(spark, f"{self.path}/data/{name}")
                fs.delete(where, True)

    # -- rows ----------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, folders, schema) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def current(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """All rows of the newest (or a kept) version; None before the first."""
        folders, schema = self.manifest(spark, version)
        return None if schema is None else self._read(spark, folders.values(), schema)

    def _write(self, rows: DataFrame, version: int) -> str:
        """Rows with their ``_bucket`` into a new version folder."""
        name = f"{version}-{uuid.uuid4().hex}"
        (rows.withColumnRenamed("_bucket", "bucket").repartition("bucket")
         .write.partitionBy("bucket").parquet(f"{self.path}/data/{name}"))
        return name

    def replace(self, rows: DataFrame) -> None:
        """A new version made of ``rows`` alone (the newest of each key)."""
        spark = rows.sparkSession
        version = (self.versions(spark) or [-1])[-1] + 1
        own = rows if self.order is None else latest_per_key(rows, self.keys, self.order)
        name = self._write(own.withColumn("_bucket", self._bucket()), version)
        held = [n.partition("=")[2] for n in self._listed(spark, f"data/{name}") if n.startswith("bucket=")]
        self._commit(spark, version, {int(b): f"{name}/bucket={b}" for b in held}, rows.schema)
        self._clean(spark)

    def merge(self, batch: DataFrame) -> int:
        """Upsert ``batch``; returns how many buckets were rewritten (0: nothing changed)."""
        spark = batch.sparkSession
        folders, schema = self.manifest(spark)
        if schema is None:
            schema = batch.schema
        batch = batch.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        version = (self.versions(spark) or [-1])[-1] + 1
        fresh = batch if self.order is None else latest_per_key(batch, self.keys, self.order)
        fresh = fresh.withColumn("_bucket", self._bucket()).persist()
        try:
            met = {r[0] for r in fresh.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
            stored = self._read(spark, [folders[b] for b in sorted(met & folders.keys())], schema)
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys]
            on = same[0]
            for s in same[1:]:
                on = on & s
            rest = [c for c in schema.names if c not in self.keys]
            found = F.col("o._here").isNotNull()
            wins = F.lit(False)
            for c in rest:
                wins = wins | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
            if self.order is not None:
                older = (F.col(f"n.{self.order}") < F.col(f"o.{self.order}")) | (
                    F.col(f"n.{self.order}").isNull() & F.col(f"o.{self.order}").isNotNull())
                wins = wins & ~F.coalesce(older, F.lit(False))
            joined = fresh.alias("n").join(stored.withColumn("_here", F.lit(True)).alias("o"), on, "left")
            changes = joined.where(~found | wins).select("n.*").persist()
            try:
                touched = {r[0] for r in changes.select("_bucket").distinct().collect()}
                if not touched:
                    return 0
                old = self._read(spark, [folders[b] for b in sorted(touched & folders.keys())], schema)
                kept = old.alias("n").join(changes.alias("o"), on, "left_anti").withColumn("_bucket", self._bucket())
                name = self._write(kept.unionByName(changes), version)
                self._commit(spark, version, folders | {b: f"{name}/bucket={b}" for b in touched}, schema)
            finally:
                changes.unpersist()
        finally:
            fresh.unpersist()
        self._clean(spark)
        return len(touched)
