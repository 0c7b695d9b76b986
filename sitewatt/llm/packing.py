"""Packing by minimum bin slack.

Each document becomes its token ids and one end id. Its full windows are sequences of
their own; what is left over (1 to WINDOW - 1 tokens) is packed whole. Only the
counts of left-over lengths matter for the plan, at most WINDOW - 1 numbers however
large the corpus: for the longest length left, a bitset of reachable sums (bit s: some
multiset of the remaining lengths fills s) finds the multiset that fills the window
closest to its capacity; backtracking through the bitsets of each length gives
its counts, and the same multiset is used for as many sequences as the remaining counts
allow. Documents then find their sequence by their rank within their length:
ranks come from counts per (length, salt), so no task orders all documents of a length.

Texts are tokenised once per distinct chunk of a batch: single spaces between two
visible characters are boundaries of the tokenizer's own splitting, so chunks
can be encoded alone; their ids are laid together by position.

Defined cases: null text is empty (the end id alone); repeated rows are packed
each; rows sharing an id and text are told apart by a number; an empty table gives no
pieces; special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import materialize, pipeline_stage

WINDOW = 1024
END_ID = 0
SALTS = 64              # at least; more where a task would order over SALT_ROWS pieces
SALT_ROWS = 200_000
RUN = 4096              # copies of one row that are ranked together
CACHE_CHUNKS = 400_000  # a generation of a worker's cache; two are held (under 200 MB)
CACHE_BYTES = 48        # of a chunk that is remembered

_encoders: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str):
    """Tokenizer and this worker's chunk cache: two generations of ids by chunk."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _encoders[path] = (t, [{}, {}])
    return _encoders[path]


def _chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row starts and the spaces at which the tokenizer certainly splits.

    A space is used only between bytes that cannot belong to white space: no
    control, space or separator character of any script stands beside it.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data == 0x20)
    at = at[(at >= 3) & (at < n - 1)]
    b1, b2, b3, f1 = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
    ok = (b1 > 0x20) & (b1 != 0x7F) & (f1 > 0x20) & ~np.isin(f1, (0x7F, 0xC2, 0xE1, 0xE2, 0xE3))
    ok &= ~((b2 == 0xC2) & (b1 >= 0x80)) & ~np.isin(b3, (0xE1, 0xE2, 0xE3))
    edge = np.zeros(n + 1, bool)
    edge[at[ok]] = True
    edge[offsets] = True
    return np.flatnonzero(edge[:-1])


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows end to end, without end ids, and the tokens before each row."""
    tokenizer, cache = _encoder(path)
    start = _chunk_starts(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    end = np.append(start[1:], len(data))
    key, first, which = np.unique(tc.word_hashes(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    young, old = cache  # by the chunk's own bytes
    words = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]
    ids = [young.get(w) or old.get(w) for w in words]
    new = [i for i, x in enumerate(ids) if x is None]
    for i, e in zip(new, tokenizer.encode_batch_fast([words[i].decode() for i in new], add_special_tokens=False)):
        ids[i] = np.array(e.ids, "<u4").tobytes()
    young.update((w, x) for w, x in zip(words, ids) if len(w) <= CACHE_BYTES)
    if len(young) > CACHE_CHUNKS:
        cache[:] = {}, young
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    pool, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
    n = size[which]
    stop = np.cumsum(n)
    out = pool[np.repeat(at[which] - (stop - n), n) + np.arange(stop[-1])]
    before = np.append(0, stop)[np.searchsorted(start, offsets)]
    return out, before


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, window: int):
    def work(batches):
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False) if b.column(0).null_count == 0 else b.column(0).to_pylist()
            out = [[] for _ in range(5)]
            for first, data, offsets in tc.chunks(b.column(1), 1 << 20):
                ids, before = encode(data, offsets, path)
                for r in range(len(offsets) - 1):
                    own = np.append(ids[before[r]:before[r + 1]], np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s:s + window]
                        for c, v in zip(out, (doc[first + r], s, len(piece), zlib.crc32(piece.tobytes()), len(own))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return work


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest one up to ``capacity``.

    Bitset subset sum: ``reach[k]`` holds the sums of the first k lengths, each
    used up to its count (by doubling). Longer lengths come first, so that
    backtracking from the shortest one leaves short lengths for later windows.
    """
    lengths = sorted((x for x, c in counts.items() if c and x <= capacity), reverse=True)
    limit = (1 << capacity + 1) - 1
    reach = [1]
    for x in lengths:
        bits, left, step = reach[-1], min(counts[x], capacity // x), 1
        while left:
            use = min(step, left)
            bits |= bits << x * use & limit
            left -= use
            step *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    total = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for k in range(len(reach) - 1, 0, -1):
        x = lengths[k - 1]
        while not reach[k - 1] >> total & 1:
            used[x] = used.get(x, 0) + 1
            total -= x
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(sequences, lengths of each) until all counts are used."""
    counts = {x: c for x, c in counts.items() if c}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = best_fill(counts, window - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[x] // c for x, c in fill.items())
        for x, c in fill.items():
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]
        out.append((times, fill))
    return out


def _slots(plans: list[tuple[int, dict[int, int]]]) -> dict[int, list[np.ndarray]]:
    """By length, for runs of ranks: first rank, first sequence, per sequence, first offset."""
    used: dict[int, int] = {}
    table: dict[int, list[list[int]]] = {}
    sequence = 0
    for times, fill in plans:
        offset = 0
        for x in sorted(fill, reverse=True):
            table.setdefault(x, []).append([used.get(x, 0), sequence, fill[x], offset])
            used[x] = used.get(x, 0) + fill[x] * times
            offset += x * fill[x]
        sequence += times
    return {x: list(np.array(rows, np.int64).T) for x, rows in table.items()}


def _place(slots: dict[int, list[np.ndarray]], base: int):
    """Give ranked rest pieces (last column: rank) their sequence and offset."""
    def work(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edge = np.flatnonzero(np.append(True, length[order][1:] != length[order][:-1])) if len(order) else []
            for lo, hi in zip(edge, [*edge[1:], len(order)]):
                own = order[lo:hi]
                x = int(length[own[0]])
                first, seq, per, off = slots[x]
                k = np.searchsorted(first, rank[own], "right") - 1
                within = rank[own] - first[k]
                sequence[own] = base + seq[k] + within // per[k]
                offset[own] = off[k] + within % per[k] * x
            cols = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=RESULT_NAMES)
    return work


RESULT = PIECE + ", sequence_id long, offset long"
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _ranks(df: DataFrame, by: list[str], order: list[str], salts: int) -> DataFrame:
    """Adds ``rank`` (from 0) within ``by``: a rank within a salt plus the salts before.

    Equal rows are counted first and ranked as runs of at most RUN copies, so a row that
    repeats without end is spread over the salts like any other rows.
    """
    same = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    runs = same.select("*", F.explode(F.expr(f"sequence(0L, copies - 1, {RUN}L)")).alias("first"))
    runs = runs.withColumn("n", F.least(F.col("copies") - F.col("first"), F.lit(RUN))).drop("copies")
    runs = runs.withColumn("salt", F.pmod(F.xxhash64(*order, "first"), F.lit(salts)))
    sizes = runs.groupBy(*by, "salt").agg(F.sum("n").alias("total"))
    w = Window.orderBy("salt") if not by else Window.partitionBy(*by).orderBy("salt")
    sizes = sizes.select(*by, "salt", (F.sum("total").over(w) - F.col("total")).alias("before"))  # one row a salt
    own = Window.partitionBy(*by, "salt").orderBy(*order, "first").rowsBetween(Window.unboundedPreceding, 0)
    ranked = runs.withColumn("own", F.sum("n").over(own) - F.col("n")).join(sizes, [*by, "salt"])
    return ranked.select(*df.columns, (F.col("own") + F.col("before")).alias("at"), "n").select(
        *df.columns, F.explode(F.expr("sequence(at, at + n - 1)")).alias("rank"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(path or tokenizer_path(), window), PIECE), "pieces")
    order = ["doc_id", "start", "ids_crc32"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    base = counts.pop(window, 0)
    salts = max(SALTS, max([base, *counts.values()]) // SALT_ROWS)
    full = _ranks(pieces.filter(F.col("length") == window), [], order, salts)
    full = full.select(*RESULT_NAMES[:5], F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = _ranks(pieces.filter(F.col("length") < window), ["length"], order, salts)
    placed = rest.select(*RESULT_NAMES[:5], "rank").mapInArrow(_place(_slots(plan(counts, window)), base), RESULT)
    return full.select([F.col(f.name) for f in T._parse_datatype_string(RESULT).fields]).union(placed)


def op7(spark, sf_dir: str) -> DataFrame:
    from sitewatt.llm.common import documents
    return pack(documents(spark, sf_dir))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces."""
    return pack(docs)
