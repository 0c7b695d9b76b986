"""Candidate search for repeated windows, shared by the two substring de-duplications.

A text is a row of symbols (bytes or word codes). Every window of ``window``
symbols belongs to its minimiser (``textcodes.units``), so equal windows meet
under equal minimisers and windows whose minimiser stands once in the corpus need
no further look. Three levels narrow the rest:

1. *units* (consecutive windows of one minimiser). A unit whose content occurs
   before is a repeat as a whole; its first occurrence goes on if another unit of
   different content has the same minimiser.
2. *parts*. A unit is cut by the windows' distance to the minimiser into PARTS
   parts; all windows of a part share a core (most of the window), whose hash is the
   group key. A part whose content occurs before is a repeat as a whole.
3. Parts of different content under one core are given to the operator's own
   matcher, which sees the symbols around the core. A core with more than HOT
   different parts (it may be a third of all rows) is cut into its single windows,
   so that no task gets an unbounded group.

Every count, minimum and join runs on keys with partial aggregation; hot keys
meet only small rows, in joins that Spark can split. Texts are shuffled only to
fetch the symbols of parts and to cut the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import drop_table, materialize

PARTS = 4
HOT = 20_000
BUCKET_ROWS = 20_000
#: Marks the core inside a part's symbols; no byte of UTF-8 text and no word code.
CORE_BYTE = 0xFF
CORE_WORD = np.uint64(0)


@dataclass(frozen=True)
class Spec:
    words: bool         # symbols are words, else bytes
    window: int
    k: int              # length of a minimiser
    by_document: bool   # a repeat needs a smaller document; else an earlier start is enough

    def symbols(self, data: np.ndarray, offsets: np.ndarray):
        """Codes of a chunk's symbols and the symbols before each row."""
        if not self.words:
            return tc.byte_codes(data), offsets
        s, e, before = tc.words(data, offsets)
        return tc.word_hashes(data, s, e) | np.uint64(1), before


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (null ids first), a hash that tells rows of one id apart, and the text."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       F.hash(F.col(text)).alias("th"), F.col(text).alias("text"))


def _anchor_counts(spec: Spec):
    def work(batches):
        for b in batches:
            for _, data, offsets in tc.chunks(b.column(0)):
                codes, at = spec.symbols(data, offsets)
                found = tc.units(tc.prefix_hash(codes), at, spec.window, spec.k)[4]
                a, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([tc.signed(a), pa.array(n)], names=["anchor", "n"])
    return work


def _unit_rows(spec: Spec):
    def work(batches):
        for b in batches:
            doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, data, offsets in tc.chunks(b.column(2)):
                codes, at = spec.symbols(data, offsets)
                rows, start, n, off, anchor, unit = tc.units(tc.prefix_hash(codes), at, spec.window, spec.k)
                yield pa.RecordBatch.from_arrays(
                    [tc.signed(anchor), tc.signed(unit), pa.array(doc[first + rows]), pa.array(th[first + rows]),
                     pa.array(start << 16 | n << 8 | off)], names=["anchor", "unit", "doc", "th", "pos"])
    return work


def _part_rows(spec: Spec):
    """Parts of the listed units of each text, with the symbols around their cores."""
    cuts = [-(-q * (spec.window - spec.k + 1) // PARTS) for q in range(PARTS + 1)]

    def work(batches):
        for b in batches:
            doc, th, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for first, data, offsets in tc.chunks(b.column(2)):
                codes, at = spec.symbols(data, offsets)
                prefix = tc.prefix_hash(codes)
                own = lists.slice(first, len(offsets) - 1)
                pos = own.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(offsets) - 1), own.value_lengths().to_numpy(zero_copy_only=False))
                start, n, off = pos >> 16, pos >> 8 & 255, pos & 255
                p = at[row] + start + off
                out = {c: [] for c in ("key", "sid", "doc", "th", "base", "n", "part", "s")}
                for q in range(PARTS):
                    low, high = cuts[q], cuts[q + 1] - 1
                    o1, o2 = np.maximum(low, off - n + 1), np.minimum(high, off)
                    has = o1 <= o2
                    a, x, y, r = p[has], o1[has], o2[has], row[has]
                    left, right = a - low, a + spec.window - high  # the core
                    key = tc.mix(tc.range_hash(prefix, left, right) + np.uint64(q))
                    sid = tc.range_hash(prefix, a - y, a + spec.window - x)
                    plain = codes if spec.words else data
                    mark = np.array([CORE_WORD if spec.words else CORE_BYTE], plain.dtype).tobytes()
                    out["s"] += [plain[i:j].tobytes() + mark + plain[k:l].tobytes() for i, j, k, l in
                                 zip((a - y).tolist(), left.tolist(), right.tolist(), (a + spec.window - x).tolist())]
                    out["key"].append(key)
                    out["sid"].append(sid)
                    out["doc"].append(doc[first + r])
                    out["th"].append(th[first + r])
                    out["base"].append(a - y - at[r])
                    out["n"].append(y - x + 1)
                    out["part"].append(np.full(len(a), high - low + 1))
                cat = {c: np.concatenate(v) for c, v in out.items() if c != "s"}
                yield pa.RecordBatch.from_arrays(
                    [tc.signed(cat["key"]), tc.signed(cat["sid"]), pa.array(cat["doc"]), pa.array(cat["th"]),
                     pa.array(cat["base"]), pa.array(cat["n"]), pa.array(cat["part"]), pa.array(out["s"], pa.binary())],
                    names=list(out)[:-1] + ["s"])
    return work


PART_SCHEMA = "key long, sid long, doc long, th int, base long, n long, part long, s binary"


def firsts(rows: DataFrame, keys: list[str], spec: Spec, extra: list) -> DataFrame:
    """The first occurrence of each content: smallest document, then start, then row."""
    return rows.groupBy(*keys).agg(F.min(F.struct("doc", "base", "th")).alias("first"), F.count("*").alias("copies"), *extra)


def _later(rows: DataFrame, first: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    """Removed ranges of the occurrences that repeat a first one."""
    f = first.filter("copies > 1").select(*keys, "first")
    later = F.col("doc") > F.col("first.doc") if spec.by_document else F.struct("doc", "base", "th") > F.col("first")
    return (rows.join(f, keys).filter(later)
            .select("doc", "th", F.col("base").alias("a"), (F.col("base") + F.col("n") - 1 + spec.window).alias("b")))


def repeated_ranges(docs: DataFrame, spec: Spec, matcher: Callable, tag: str) -> DataFrame:
    """Ranges [a, b) of symbols to remove, by (doc, th); they may overlap.

    ``docs`` has doc, th, text (``keyed``). ``matcher`` takes one core's different
    parts as lists (first document, first start, windows, symbols of one window
    with its core as one, content) and yields (index, first window, last window).
    """
    anchors = (docs.select("text").mapInArrow(_anchor_counts(spec), "anchor long, n long")
               .groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"))
    anchors = materialize(anchors, f"{tag}-anchors")
    rows = docs.mapInArrow(_unit_rows(spec), "anchor long, unit long, doc long, th int, pos long")
    rows = materialize(rows.join(anchors, "anchor", "left_semi"), f"{tag}-units")
    drop_table(anchors)
    rows = rows.withColumns({"base": F.shiftright("pos", 16), "n": F.shiftright("pos", 8).bitwiseAND(F.lit(255))})
    unit = materialize(firsts(rows, ["anchor", "unit"], spec, [F.max("pos").bitwiseAND(F.lit(65535)).alias("shape")]),
                       f"{tag}-firsts")
    ranges = [_later(rows, unit, ["anchor", "unit"], spec)]

    several = unit.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    todo = unit.join(several, "anchor", "left_semi")
    if spec.by_document:  # every occurrence in the first document: none of them is a repeat yet
        todo = rows.join(todo.select("anchor", "unit", "first"), ["anchor", "unit"]).filter(F.col("doc") == F.col("first.doc"))
        todo = todo.select("doc", "th", "pos")
    else:
        todo = todo.select("first.doc", "first.th", (F.shiftleft(F.col("first.base"), 16) + F.col("shape")).alias("pos"))
    todo = (todo.groupBy("doc", "th").agg(F.collect_list("pos").alias("list")))  # bounded by the text's length
    parts = (docs.join(todo.hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "text", "list")
             .mapInArrow(_part_rows(spec), PART_SCHEMA))
    parts = materialize(parts, f"{tag}-parts")
    part = materialize(firsts(parts, ["key", "sid"], spec, [F.max(F.struct("n", "part", "s")).alias("x")]),
                       f"{tag}-contents")
    ranges.append(_later(parts, part, ["key", "sid"], spec))

    sizes = part.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    part = part.join(sizes, "key").select("key", "sid", "first", "x.*", "c")
    if spec.by_document:
        own = parts.select("key", "sid", F.struct("doc", "base", "th").alias("own"))
        part = (part.join(own, ["key", "sid"]).filter(F.col("own.doc") == F.col("first.doc")).drop("first")
                .withColumnRenamed("own", "first"))
    buckets = max(1, part.count() // BUCKET_ROWS)
    out = "doc long, th int, a long, b long"
    ranges.append(part.filter(F.col("c") <= HOT).withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets)))
                  .select("bucket", "key", "first.*", "n", "part", "s")
                  .groupBy("bucket").applyInArrow(_match_bucket(spec, matcher), out))
    single = (part.filter(F.col("c") > HOT).select("key", "first.*", F.lit(1).alias("n"), F.posexplode(_windows(spec)))
              .select(F.xxhash64("key", "col").alias("key"), F.lit(0).alias("sid"), "doc", "th",
                      (F.col("base") + F.col("pos")).alias("base"), "n"))
    ranges.append(_later(single, firsts(single, ["key", "sid"], spec, []), ["key", "sid"], spec))
    found = ranges[0]
    for r in ranges[1:]:
        found = found.unionByName(r)
    return found


def _windows(spec: Spec):
    """A part's windows as separate contents (for hot cores)."""
    width = 8 if spec.words else 1
    return F.expr(f"transform(sequence(0, cast(n as int) - 1), i -> substring(s, i * {width} + 1, cast(part as int) * {width}))")


def _match_bucket(spec: Spec, matcher: Callable):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key = table["key"].to_numpy()
        cols = {c: table[c].to_pylist() for c in ("doc", "base", "th", "n", "part", "s")}
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
        out = ([], [], [], [])
        for lo, hi in zip(edge, edge[1:]):
            own = {c: v[lo:hi] for c, v in cols.items()}
            for i, a, b in matcher(own["doc"], own["base"], own["n"], own["part"][0], own["s"]):
                base = own["base"][i]
                for c, v in zip(out, (own["doc"][i], own["th"][i], base + a, base + b + spec.window)):
                    c.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["doc", "th", "a", "b"])
    return work


def runs(flags: list[bool]):
    """(first, last) of each run of true flags."""
    start = None
    for i, f in enumerate(flags):
        if f and start is None:
            start = i
        elif not f and start is not None:
            yield start, i - 1
            start = None
    if start is not None:
        yield start, len(flags) - 1


def merge_ranges(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-touching ranges covering the same symbols."""
    out: list[list[int]] = []
    order = np.argsort(a, kind="stable")
    for s, e in zip(a[order].tolist(), b[order].tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def with_ranges(docs: DataFrame, ranges: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every row of ``docs`` with the ranges found in its text (null: none)."""
    key = {"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "__th": F.hash(F.col(text))}
    found = ranges.groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(
        F.collect_list("a").alias("__a"), F.collect_list("b").alias("__b"))  # bounded by the text's length
    return docs.withColumns(key).join(found.hint("shuffle_hash"), ["__doc", "__th"], "left").drop("__doc", "__th")
