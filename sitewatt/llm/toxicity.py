"""Toxicity severity by cumulative-link (proportional odds) regression.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight per hashed word, shared by all
ordered thresholds. x marks the distinct words of the whole text.

Limit: the given labels hold toxic 0/1 and no grades. A toxic row counts as grade 2 where
it holds at least ``MARKERS`` different words that stand in many toxic and no other
sampled rows, else as 1, so the upper threshold learns a rule made from the same words.
``fit`` takes any ordered grades; the tests show it ordering true ones.

The model is fitted with proximal gradient steps (L1, so words that carry no signal get
no weight) on a bounded sample: the labelled documents of the ``max_rows`` smallest
hashed ids, of which those with more than ``max_features`` different words are left out
(at most 8,000 rows of 4,096 words, 131 MB, reach the driver). Ids are chosen first, from
labels and ids alone, and their texts are then picked out by a broadcast of these ids: no
text is shuffled. Every document is scored. The expected severity is the sum of P(grade >
j) over the thresholds.

Defined cases: null text has no words; rows without or with null labels are scored,
not learnt from; repeated rows are scored each and learnt from once; without any
labelled row all weights are zero and severity is 0; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import materialize

BITS = 18
MAX_ROWS = 8000
MAX_FEATURES = 4096
MARKERS = 3
GRADES = 3
LETTERS = np.ones(256, bool)  # word characters: letters, digits and everything beyond ASCII
LETTERS[:128] = [chr(i).isalnum() for i in range(128)]


def _words(data: np.ndarray, offsets: np.ndarray):
    """Row and feature of every word of a chunk, lower-cased."""
    plain = np.where(LETTERS[data], tc.lower_ascii(data), np.uint8(0x20)).astype(np.uint8)
    s, e, before = tc.words(plain, offsets)
    h = tc.word_hashes(plain, s, e)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(before)), (h >> np.uint64(64 - BITS)).astype(np.int64)


def _feature_rows(batches):
    for b in batches:
        lists, ends = [], [0]
        for _, data, offsets in tc.chunks(b.column(1)):
            row, x = _words(data, offsets)
            code = np.unique(row << BITS | x)
            lists.append((code & (1 << BITS) - 1).astype(np.int32))
            ends += (ends[-1] + np.searchsorted(code >> BITS, np.arange(1, len(offsets)))).tolist()
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                                          b.column(2)], names=["id", "x", "toxic"])


def grades(rows: np.ndarray, x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0, or 1 and 2 of toxic rows by their number of marker words."""
    seen = np.bincount(x[toxic[rows] == 1], minlength=1 << BITS)
    clean = np.bincount(x[toxic[rows] == 0], minlength=1 << BITS)
    marker = (clean == 0) & (seen >= max(5, 0.02 * (toxic == 1).sum()))
    held = np.bincount(rows[marker[x]], minlength=len(toxic))
    return np.where(toxic == 1, 1 + (held >= MARKERS), 0)


def fit(rows: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 500, l1: float = 0.25, rate: float = 0.3):
    """Weights and ascending thresholds (``GRADES`` - 1) of the ordinal model."""
    n = len(y)
    w, base, gaps = np.zeros(1 << BITS), 0.0, np.ones(GRADES - 2)
    sw, sb, sg = np.full(1 << BITS, 1e-8), 1e-8, np.full(GRADES - 2, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(steps if n else 0):
        theta = base + np.append(0, np.cumsum(np.exp(gaps)))
        score = np.bincount(rows, w[x], minlength=n)
        upper = np.append(theta, np.inf)[y] - score
        lower = np.append(-np.inf, theta)[y] - score
        fu, fl = sigmoid(upper), sigmoid(lower)
        fu[np.isinf(upper)], fl[np.isinf(lower)] = 1, 0
        p = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p
        gs = du - dl  # of the loss by score
        gt = np.bincount(y, -du, minlength=GRADES)[:-1] + np.bincount(y, dl, minlength=GRADES)[1:]
        gw = np.bincount(x, gs[rows], minlength=1 << BITS)
        sw += gw * gw
        step = rate / np.sqrt(sw)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        sb += gt.sum() ** 2
        base -= rate * gt.sum() / np.sqrt(sb)
        gg = np.array([gt[j + 1:].sum() for j in range(GRADES - 2)]) * np.exp(gaps)
        sg += gg * gg
        gaps = gaps - rate * gg / np.sqrt(sg)
    return w, base + np.append(0, np.cumsum(np.exp(gaps))) if n else np.full(GRADES - 1, 40.0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES):
    """Fit on the documents of the ``max_rows`` smallest hashed labelled ids."""
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("__toxic"))
    ids = (known.join(docs.select("doc_id"), "doc_id", "left_semi")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    ids = materialize(ids, "sampled-ids")
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_rows ids
    sample = (own.select("doc_id", F.col("text"), "__toxic").mapInArrow(_feature_rows, "id long, x array<int>, toxic long")
              .filter(F.size("x") <= max_features).groupBy("id", "toxic").agg(F.min("x").alias("x"))
              .orderBy(F.xxhash64("id"), "id").toArrow())
    lists = sample["x"].combine_chunks()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    y = grades(rows, x, sample["toxic"].to_numpy().astype(np.int64)) if len(lists) else np.zeros(0, np.int64)
    return fit(rows, x, y)


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, expected severity (0 to GRADES - 1) and most likely grade of every row."""
    weights, theta = model
    held = np.flatnonzero(weights)
    values = weights[held]

    def work(batches):
        w = np.zeros(1 << BITS)
        w[held] = values
        for b in batches:
            totals = []
            for _, data, offsets in tc.chunks(b.column(1)):
                row, x = _words(data, offsets)
                use = w[x] != 0
                code = np.unique(row[use] << BITS | x[use])
                totals.append(np.bincount(code >> BITS, w[code & (1 << BITS) - 1], minlength=len(offsets) - 1))
            z = np.concatenate(totals) if totals else np.zeros(0)
            above = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -40, 40)))
            p = np.diff(np.column_stack([np.ones(len(z)), above, np.zeros(len(z))]), axis=1) * -1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(above.sum(axis=1), 6)), pa.array(p.argmax(axis=1))],
                                             names=["doc_id", "severity", "grade"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(work, "doc_id long, severity double, grade long")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumn("toxic", F.col("severity") >= 0.5)
