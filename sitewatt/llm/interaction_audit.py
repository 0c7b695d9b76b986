"""Filter interaction audit by incremental retraction streaming.

Which of five filters removes, duplicates or alone explains what, in every order they
can be applied in? All follows from how many documents of a part fail which set of
filters (a mask of five bits). Four bits depend on the document alone; the fifth
(identical to a smaller id's text) on the whole table.

All files run through one streaming query as available-now micro-batches. State is
keyed by text: a bucket of text digests holds, for each digest, the smallest id seen
and what stands there. A document that comes with a larger id counts as a copy at
once; when a smaller id arrives, the documents that held the place are retracted from
their part counters (minus one at the old mask, plus one with the copy bit) and the
newcomer takes the place. The counters are the sums of these deltas, appended exactly
once per micro-batch; a restarted query goes on from its checkpoint. Labels are joined to
the deltas once, when the stream has ended.

Scale: texts never leave the first map step, only their 128-bit digest does. Of a text
that many rows of an Arrow batch share only the smallest id goes to the text's bucket; the
others are copies whatever else comes, and are spread over the buckets by their id. So a hot
text costs each batch of rows one row in its bucket. The number of buckets grows with the
table. The final table is made of at most 32 masks a part.

Defined cases: null text is the empty text; null part is the empty string; a null id is
smaller or larger than none: never a copy and never makes one; rows that share the
smallest id are no copies of each other; several label rows of an id count as one that
is 1 where any is; null labels are 0; an empty table gives an empty result; columns
other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import drop_folders, materialize
from sitewatt.session import checkpoint_dir

FILTERS = "ABCDE"
COPY = 16                # the bit of filter E
BATCHES = 4              # micro-batches over all files
BUCKET = 512             # texts of a state row, about
ROWS = 64
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


def own_mask(raw: bytes) -> int:
    """Bits of the filters that depend on the text alone (A to D)."""
    words = raw.split()  # of bytes: at the six ASCII white-space characters
    points = len(raw) if raw.isascii() else len(raw.translate(None, _CONTINUED))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marks = len(raw) != len(raw.translate(None, _MARKS))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | marks << 3


def _rows(buckets: int):
    """One row per document (equal rows of an Arrow batch counted once): its mask and digest, and where it goes.

    Of the documents of a batch that share a text, those with the smallest id go to the text's bucket. The others
    are copies whatever else comes: they carry the copy bit already and go to a bucket by their id.
    """
    def work(batches):
        for b in batches:
            ids = b.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            mask, d0, d1 = [], [], []
            texts = b.column(1).cast(pa.large_binary())
            for at in range(0, len(texts), ROWS):
                for raw in texts.slice(at, ROWS).to_pylist():
                    raw = raw or b""
                    mask.append(own_mask(raw))
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    d0.append(int.from_bytes(digest[:8], "little", signed=True))
                    d1.append(int.from_bytes(digest[8:], "little", signed=True))
            t = pd.DataFrame({"d0": np.array(d0, np.int64), "d1": np.array(d1, np.int64),
                              "doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False), "part": b.column(2).to_pylist(),
                              "mask": np.array(mask, np.int64), "named": named})
            t = t.groupby([*HELD, "named"], as_index=False).size().rename(columns={"size": "n"})
            least = t.where(t["named"]).groupby(["d0", "d1"])["doc_id"].transform("min")
            t["claims"] = t["named"] & (t["doc_id"] == least)
            t["mask"] |= np.where(t["named"] & ~t["claims"], COPY, 0)
            bucket = np.where(t["claims"], t["d0"], tc.mix(t["doc_id"].to_numpy(np.int64).view(np.uint64)).view(np.int64) ^ t["d0"])
            t["bucket"] = np.mod(bucket, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(t[f.name], f.type) for f in _ROWS], schema=_ROWS)
    return work


HELD = ["d0", "d1", "doc_id", "part", "mask"]
_ROWS = pa.schema([("bucket", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()),
                   ("mask", pa.int64()), ("named", pa.bool_()), ("claims", pa.bool_()), ("n", pa.int64())])
ROWS_SCHEMA = "bucket long, d0 long, d1 long, doc_id long, part string, mask long, named boolean, claims boolean, n long"
DELTAS = "doc_id long, named boolean, part string, mask long, delta long"


def _pack(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held[[*HELD, "n"]], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def advance(held: pd.DataFrame | None, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a bucket holds after ``new`` rows, and the changes of the part counters by document.

    ``held``: the rows at the smallest id of each text seen so far. Rows of ``new`` that do not
    claim a place (copies for certain, and rows without id) are counted as they are.
    """
    claims = new["claims"].astype(bool)
    rows = new[claims].assign(old=False)
    if held is not None:
        rows = pd.concat([held.assign(old=True, named=True), rows])
    rows = rows.reset_index(drop=True).astype({"old": bool})
    late = rows["doc_id"] > rows.groupby(["d0", "d1"])["doc_id"].transform("min")
    rows = rows.assign(copied=rows["mask"] | COPY, late=late, delta=rows["n"])
    moved, came = rows[rows["old"] & late], rows[~rows["old"]]
    deltas = [new[~claims].assign(delta=new.loc[~claims, "n"].to_numpy()),
              came.assign(mask=np.where(came["late"], came["copied"], came["mask"])),
              moved.assign(delta=-moved["delta"].to_numpy()),          # retracted
              moved.assign(mask=moved["copied"].to_numpy())]
    changes = pd.concat([d for d in deltas if len(d)] or deltas[:1])
    kept = rows[~late].groupby(HELD, as_index=False)["n"].sum()
    return kept, changes[["doc_id", "named", "part", "mask", "delta"]].reset_index(drop=True)


def _update(key, frames, state):
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
    held, changes = advance(held, pd.concat(list(frames), ignore_index=True))
    state.update((_pack(held),))
    yield changes


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own for the query, so that none of the caller's settings change. It takes over the
    caller's state store (``session.cluster_conf`` names RocksDB; the default holds the packed state, some
    60 bytes a text, in the executors' memory)."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"):
        own.conf.set(key, spark.conf.get(key))
    return own


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def mask_counters(spark: SparkSession, docs_path: str, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
                  part: str = "lang", batches: int = BATCHES, bucket: int = BUCKET) -> DataFrame:
    """``part, mask, flags, n``: documents of a part by the set of filters they fail (``flags``: 1 quality, 2 toxic)."""
    stored = spark.read.parquet(docs_path)
    files, rows = len(stored.inputFiles()), stored.count()  # from the files' footers
    folder = f"{checkpoint_dir(spark)}/llm-audit-{uuid.uuid4().hex}"
    own = _session(spark)
    source = (own.readStream.schema(stored.select(doc_id, text, part).schema)
              .option("maxFilesPerTrigger", max(1, -(-files // batches))))
    if _is_file(spark, docs_path):  # a stream reads folders
        above, name = docs_path.rstrip("/").rsplit("/", 1)
        source = source.option("pathGlobFilter", name).parquet(above)
    else:
        source = source.parquet(docs_path)
    docs = source.select(F.col(doc_id).cast("long"), F.col(text), F.coalesce(F.col(part).cast("string"), F.lit("")))
    deltas = docs.mapInArrow(_rows(max(1, -(-rows // bucket))), ROWS_SCHEMA).groupBy("bucket").applyInPandasWithState(
        _update, DELTAS, "held binary", "append", GroupStateTimeout.NoTimeout)
    query = (deltas.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/deltas")
             .option("checkpointLocation", f"{folder}/query").trigger(availableNow=True).start())
    query.awaitTermination()
    own.createDataFrame([], DELTAS).write.mode("append").parquet(f"{folder}/none")
    found = spark.read.schema(DELTAS).parquet(f"{folder}/none", *([f"{folder}/deltas"] if files else []))
    found = found.withColumn("doc_id", F.expr("if(named, doc_id, null)"))
    if labels is None:
        found = found.withColumn("flags", F.lit(0))
    else:
        one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
            (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("flags"))
        found = found.join(one, "doc_id", "left").withColumn("flags", F.coalesce("flags", F.lit(0)))
    counters = found.groupBy("part", "mask", "flags").agg(F.sum("delta").alias("n")).where("n != 0")
    counters = materialize(counters, "audit-counters")
    drop_folders(spark, {folder})
    return counters


def audit(counters: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, for every part."""
    orders = F.lit(",".join(map("".join, itertools.permutations(FILTERS))))
    few = counters.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("flags").bitwiseAND(1) != 0, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("flags").bitwiseAND(2) != 0, F.col("n")).otherwise(0)).alias("toxic"))
    rows = (few.select("*", F.explode(F.split(orders, ",")).alias("filter_order"))
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")))
    place = [F.instr("filter_order", f) for f in FILTERS]
    rows = rows.withColumns({"own": sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0)),
                             "before": sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))})
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails).alias("kept"), total(~earlier & fails).alias("removed"), total(earlier & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~earlier & fails, "good").alias("good_lost"), total(~earlier & fails, "toxic").alias("toxic_lost"),
        # of the 120 orders, the filter is first among the k that a document fails in 120 / k
        F.sum(F.when(fails, F.expr("n * 120 div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"))


def op11(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(mask_counters(spark, f"{sf_dir}/documents.parquet", labels))


_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(
    ["len(w) < 100", "100 * len(list_distinct(w)) < 80 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)",
     "regexp_matches(t, '[#$%&*|]')", "coalesce(first_id < doc_id, FALSE)"]))

SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, {_BITS} AS mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM texts LEFT JOIN marks USING (doc_id)
),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM masks GROUP BY part, mask
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         list_sum([CASE WHEN i < step THEN 1 << (ascii(filter_order[i]) - 65) ELSE 0 END FOR i IN [1, 2, 3, 4, 5]]) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
cells AS (
  SELECT part, filter_order, step, own, mask, n, good, toxic, (mask & own) <> 0 AS fails, (mask & CAST(before AS BIGINT)) <> 0 AS earlier
  FROM counts, steps
),
audit AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(CASE WHEN NOT earlier AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT earlier AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN earlier AND fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT earlier AND fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT earlier AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit"""
