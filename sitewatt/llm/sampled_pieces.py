"""Sampled segmentation with a SentencePiece vocabulary; lossless decoding.

Pieces are byte strings ("▁" is the space), each single byte has its fallback piece,
so every text has a segmentation and decoding is the joining of bytes. A piece of rank
r weighs 1 / (r + RANK_SHIFT); a byte that no piece covers weighs FALLBACK. A segmentation's
probability is proportional to the product of its weights, to the power ``sharpness``.

*Forward filtering* sums the weights of all segmentations of each prefix of a word
(no piece goes on after a space, so spaces after a visible character cut the
lattice), once for each distinct word of a chunk. *Backward sampling* draws the last piece
by its share of the sum, then the one before, for all words of a chunk in step.
Random numbers are hashes of the seed, the row key, the word's place in the text and
the position, so a row's segmentation does not depend on batches, tasks or retries.

Defined cases: null and empty texts have no pieces; repeated rows get the same pieces;
special pieces' names in a text are ordinary bytes; a null key is 0; an empty table gives
an empty result; other columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm import textcodes as tc

RANK_SHIFT = 2000.0
FALLBACK = 1e-7
CHUNK = 1 << 19
LOOKUPS = 1 << 14        # pieces looked up in one call
FEW = 64                 # long words of a chunk that are walked one by one
WALK = 1 << 16           # positions drawn at a time

_vocabularies: dict = {}


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as byte strings, found by hash; log weights by piece."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [b""] * sp.get_piece_size()
        self.fallback = np.zeros(256, np.int64)
        entries = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.fallback[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                entries[self.bytes_of[i]] = i
        self.longest = max(map(len, entries))
        ids = np.array(list(entries.values()), np.int64)
        raw = [b for b in entries]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(b) for b in raw])
        starts = ends - np.array([len(b) for b in raw])
        h = tc.range_hash(tc.prefix_hash(tc.byte_codes(data)), starts, ends)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], ids[order]
        weight = -np.array([sp.get_score(i) for i in self.ids.tolist()]) if len(ids) else np.zeros(0)
        self.weight = -np.log(np.maximum(weight, 0) + RANK_SHIFT)
        self.seen = np.zeros(1 << 20, bool)  # by the hash's upper bits: most strings are no piece
        self.seen[self.hashes >> np.uint64(44)] = True

    def find(self, h: np.ndarray):
        ids, weight = np.full(len(h), -1), np.full(len(h), -np.inf)
        some = np.flatnonzero(self.seen[h >> np.uint64(44)])
        own = h[some]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        ok = self.hashes[at] == own
        ids[some[ok]], weight[some[ok]] = self.ids[at[ok]], self.weight[at[ok]]
        return ids, weight


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the lattice's independent stretches: rows and spaces after non-spaces."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def _filter(data, prefix, at, n, vocab: Vocabulary, sharpness: float):
    """Forward pass over distinct words [at, at + n), longest first.

    Returns each word's first row in the tables, and for every prefix of a word the
    cumulative shares of the last piece's lengths (1, 2, ...) and the pieces.
    """
    base = np.cumsum(n + 1) - (n + 1)
    width = min(vocab.longest, int(n[0]))
    total = np.full(int((n + 1).sum()), -np.inf)          # log sum of all segmentations of a prefix
    total[base] = 0.0
    share = np.zeros((len(total), width), np.float32)
    piece = np.zeros((len(total), width), np.int32)
    running = len(n)
    lengths = np.arange(1, width + 1)
    t = 1
    while t <= n[0]:
        while n[running - 1] < t:
            running -= 1
        # Pieces that end at the next ``span`` positions of the words still running, looked up in one call.
        span = int(min(n[running - 1] - t + 1, max(1, LOOKUPS // (width * running))))
        ends = t + np.arange(span)
        fits = lengths[None, :] <= ends[:, None]                      # end x length
        e = at[None, None, :running] + ends[:, None, None]
        s = np.maximum(e - lengths[None, :, None], at[None, None, :running])
        e = np.broadcast_to(e, s.shape)
        ids, w = vocab.find(tc.range_hash(prefix, s.ravel(), e.ravel()))
        ids, w = ids.reshape(s.shape), w.reshape(s.shape)
        low = ids[:, 0] < 0
        ids[:, 0] = np.where(low, vocab.fallback[data[s[:, 0]]], ids[:, 0])
        w[:, 0] = np.where(low, np.log(FALLBACK), w[:, 0])
        if running == 1:  # the rest of one long word: the same steps on its own rows
            here = int(base[0]) + t
            piece[here:here + span] = ids[:, :, 0]
            weights = sharpness * w[:, :, 0]
            for k in range(span):
                reach, h = min(t + k, width), here + k
                step = weights[k, :reach] + total[h - reach:h][::-1]
                best = step.max()
                step = np.exp(step - best).cumsum()
                total[h] = best + np.log(step[-1])
                share[h, :reach - 1] = step[:-1] / step[-1]
                share[h, reach - 1:] = 2.0
            t += span
            continue
        for k in range(span):
            reach = int(fits[k].sum())
            here = base[:running] + t + k
            step = sharpness * w[k, :reach] + total[here[None, :] - lengths[:reach, None]]
            piece[here, :reach] = ids[k, :reach].T
            best = step.max(axis=0)
            np.exp(step - best, out=step)
            np.cumsum(step, axis=0, out=step)
            total[here] = best + np.log(step[-1])
            share[here, :reach] = (step / step[-1]).T
            share[here, reach - 1:] = 2.0
        t += span
    return base, share, piece


def _draws(rand, left: np.ndarray) -> np.ndarray:
    """The number in [0, 1) that a word (``rand``) draws with ``left`` bytes left."""
    mixed = tc.mix(rand + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((mixed >> np.uint64(40)) / float(1 << 24)).astype(np.float32)


def _walk(share, piece, row: int, n: int, start: int, rand):
    """Places and pieces of one word, from its end; ``row``: its first row in the tables."""
    picks = np.concatenate([(share[row + lo + 1:row + min(n, lo + WALK) + 1] <= _draws(rand, np.arange(lo + 1, min(n, lo + WALK) + 1))[:, None])
                            .sum(axis=1) for lo in range(0, n, WALK)]).tolist()
    left, places = n, []
    while left:
        left -= picks[left - 1] + 1
        places.append(left)
    ends = np.array([n, *places[:-1]])
    places = np.array(places)
    return start + places, piece[row + ends, ends - places - 1]


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocab: Vocabulary, seed: int = 0, sharpness: float = 1.0):
    """Piece ids of all rows end to end and the pieces before each row."""
    start = _segments(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    size = np.diff(np.append(start, len(data)))
    prefix = tc.prefix_hash(tc.byte_codes(data))
    _, first, which = np.unique(tc.word_hashes(data, start, start + size), return_index=True, return_inverse=True)
    row = np.searchsorted(offsets, start, "right") - 1
    own = tc.mix(keys[row].astype(np.int64).view(np.uint64) ^ tc.mix(np.array([seed], np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
    own = tc.mix(own + (start - offsets[row]).astype(np.uint64))
    drawn = []
    low = 0
    for high in (6, 9, 13, 20, len(data)):  # words of like length share tables of one width
        some = np.flatnonzero((size[first] > low) & (size[first] <= high))
        low = high
        if not len(some):
            continue
        some = some[np.argsort(-size[first[some]], kind="stable")]  # longest first: words still running are a prefix
        table = np.full(len(first), -1, np.int64)
        base, share, piece = _filter(data, prefix, start[first[some]], size[first[some]], vocab, sharpness)
        table[some] = base
        active = np.flatnonzero(table[which] >= 0)
        if high == len(data) and len(active) <= FEW:  # long words: all draws at once, then a walk
            for k in active.tolist():
                drawn.append(_walk(share, piece, int(table[which[k]]), int(size[k]), int(start[k]), own[k]))
            continue
        begin, left, word, rand = start[active], size[active], table[which[active]], own[active]
        while len(left):
            flat = word + left
            pick = (share[flat] <= _draws(rand, left)[:, None]).sum(axis=1)
            left = left - pick - 1
            drawn.append((begin + left, piece[flat, pick]))
            go = left > 0
            begin, left, word, rand = begin[go], left[go], word[go], rand[go]
    place = np.concatenate([p for p, _ in drawn])
    ids = np.concatenate([i for _, i in drawn]).astype(np.int64)
    order = np.argsort(place)
    return ids[order], np.searchsorted(place[order], offsets)


def decode(ids, vocab: Vocabulary) -> bytes:
    return b"".join([vocab.bytes_of[i] for i in ids])


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _encode(path: str, seed: int, sharpness: float, digest: bool):
    def work(batches):
        vocab = vocabulary(path)
        for b in batches:
            keys, out = _keys(b.column(0)), []
            for first, data, offsets in tc.chunks(b.column(1), CHUNK):
                ids, before = sample(data, offsets, keys[first:first + len(offsets) - 1], vocab, seed, sharpness)
                raw = data.tobytes()
                for r in range(len(offsets) - 1):
                    x = ids[before[r]:before[r + 1]]
                    if digest:
                        same = decode(x.tolist(), vocab) == raw[offsets[r]:offsets[r + 1]]
                        out.append((len(x), zlib.crc32(x.astype("<u4").tobytes()), same))
                    else:
                        out.append((x.astype(np.int32),))
            names, types = ((("n_pieces", "ids_crc32", "lossless"), (pa.int64(), pa.int64(), pa.bool_())) if digest
                            else (("piece_ids",), (pa.list_(pa.int32()),)))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([o[i] for o in out], t) for i, t in enumerate(types)],
                                             names=["doc_id", *names])
    return work


def encode_sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, sharpness: float = 1.0,
                   path: str | None = None) -> DataFrame:
    """``doc_id, piece_ids``: one sampled segmentation of every row's whole text."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        _encode(path or model_path(), seed, sharpness, False), "doc_id long, piece_ids array<int>")


def decode_pieces(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, piece_ids``: the exact text."""
    path = path or model_path()

    def work(batches):
        vocab = vocabulary(path)
        for b in batches:
            texts = [None if x is None else decode(x, vocab).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pieces.select("doc_id", "piece_ids").mapInArrow(work, "doc_id long, text string")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(model_path(), 0, 1.0, True), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
