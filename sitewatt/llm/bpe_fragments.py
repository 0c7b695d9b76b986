"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never
be merged across, whatever stands around it: a certain cut. White space stands in
no token at all, so every text first falls into runs without white space; the
tokenizer's own normaliser and pre-tokenizer split a run into words, and certain cuts
split a word into fragments. Fragments are encoded each on its own, the last one of
a word with the word-end mark, the others without, and the ids are concatenated.
Equal runs and fragments are looked up by their bytes (never by a hash) in bounded
per-worker tables, so most of a corpus is a dictionary look-up.

Why this equals the library's result: added tokens hold no white space; composition
(NFC), lower-casing and the split pattern never reach over ASCII white space; and a
merge needs a token that holds both sides of its seam.

Defined cases: null text is the empty text, without ids; repeated rows are encoded
each; an empty table gives an empty result; only the named columns are read, so extra
columns of any name do not matter. Strings of special tokens in a text become these
tokens, as in the library. A text is worked through in blocks of about a megabyte cut
at white space, so memory depends on the longest run without white space (about 60
bytes per byte of it), not on the length of the text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20     # bytes of a text worked on at a time
TABLE = 1 << 19     # runs and fragments remembered by a worker, each about
ROWS = 64           # rows turned into Python objects at a time

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Printable ASCII and Latin letters and signs up to U+017F: one composed form, one class and one
#: lower case in every version of Unicode, so they need not go through the tokenizer's own rules.
_STABLE = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017f]*").fullmatch


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> dict[int, int]:
    """Byte-level symbols: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return dict(zip(own, own)) | {b: 256 + i for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder of one tokenizer file (BPE over byte symbols with a word-end mark)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        plain = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        inner = plain | {"model": model | {"end_of_word_suffix": None}}
        # by whether the fragment ends its word: only the last one gets the word-end mark
        self.encoders = {True: Tokenizer.from_str(json.dumps(plain)), False: Tokenizer.from_str(json.dumps(inner))}
        self.joined = set()             # pairs of neighbours inside any token
        for token in model["vocab"]:
            body = token.removesuffix(self.mark) if self.mark else token
            self.joined.update(map(str.__add__, body, body[1:]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        pattern = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.forget()
        self.pattern = regex.compile(pattern[0], regex.VERSION0)
        self.symbol = str.maketrans(_byte_symbols())

    def forget(self) -> None:
        self.ids, self.texts, self.silent = {}, {}, set()    # of runs; silent ones have no token
        self.word_ids = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.word_texts = {t: t.encode() for t in self.special}

    def cuts(self, word: str) -> list[str]:
        """``word`` (byte symbols) cut wherever two neighbours stand inside no token."""
        joined = self.joined
        if joined.issuperset(map(str.__add__, word, word[1:])):
            return [word]
        at = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in joined]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])]

    def words(self, text: str) -> list[str]:
        """The tokenizer's words of a run, as byte symbols."""
        if _STABLE(text):
            found = self.pattern.findall(text.lower())
            return found if text.isascii() else [w.encode().decode("latin-1").translate(self.symbol) for w in found]
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)) if text else []
        return [w for w, _ in split]

    def encode_fragments(self, wanted: set[str], last: bool) -> dict[str, tuple[bytes, bytes]]:
        """Ids (little-endian) and token strings of fragments, each encoded on its own."""
        if not wanted:
            return {}
        texts = list(wanted)
        found = self.encoders[last].encode(" ".join(texts), add_special_tokens=False)
        ids, tokens = np.array(found.ids, "<u4").tobytes(), found.tokens
        ends = np.searchsorted(np.array(found.word_ids), np.arange(1, len(texts) + 1)).tolist()
        return {t: (ids[4 * i:4 * j], " ".join(tokens[i:j]).encode()) for t, i, j in zip(texts, [0, *ends], ends)}

    def learn_words(self, words: set[str]) -> None:
        """Cut words not met before and encode all their fragments, one call for each kind."""
        cut = {w: self.cuts(w) for w in words}
        inner = self.encode_fragments({f for c in cut.values() for f in c[:-1]}, False)
        last = self.encode_fragments({c[-1] for c in cut.values()}, True)
        for w, c in cut.items():
            found = [*map(inner.__getitem__, c[:-1]), last[c[-1]]]
            self.word_ids[w] = b"".join([i for i, _ in found])
            self.word_texts[w] = b" ".join([t for _, t in found])

    def learn(self, runs) -> None:
        """Encode runs not met before."""
        wanted = set(runs)
        new = wanted.difference(self.ids)
        if not new:
            return
        if len(self.ids) + len(new) > TABLE:  # also of runs met before that are wanted now
            self.forget()
            new = wanted
        plan = []
        for raw in new:
            text = raw.decode("utf-8")
            if "<" in text and self.split:
                parts = [[p] if p in self.special else self.words(p) for p in self.split.split(text)]
                words = [w for p in parts for w in p]
            else:
                words = self.words(text)
            plan.append((raw, words))
        self.learn_words({w for _, words in plan for w in words}.difference(self.word_ids))
        for raw, words in plan:
            if len(words) == 1:
                self.ids[raw], self.texts[raw] = self.word_ids[words[0]], self.word_texts[words[0]]
            else:
                self.ids[raw] = b"".join([self.word_ids[w] for w in words])
                self.texts[raw] = b" ".join([self.word_texts[w] for w in words])
                if not words:
                    self.silent.add(raw)

    def speaking(self, runs: list[bytes]) -> list[bytes]:
        """The runs that have tokens."""
        return [w for w in runs if w not in self.silent] if self.silent else runs

    def blocks(self, raw: bytes):
        """The text's runs without white space, block by block."""
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > BLOCK:
                space = _SPACE.search(raw, at + BLOCK)
                end = space.start() if space else end
            runs = raw[at:end].split()
            self.learn(runs)
            yield self.speaking(runs)
            at = end

    def ids_of(self, blocks) -> bytes:
        return b"".join([b"".join(map(self.ids.__getitem__, block)) for block in blocks])

    def encode(self, raw: bytes) -> bytes:
        return self.ids_of(self.blocks(raw))

    def decode(self, ids) -> str:
        """Token strings with a space between (this file names no decoder), special ones kept."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_OPEN: dict[str, ForcedBoundaryBpe] = {}


def codec(path: str) -> ForcedBoundaryBpe:
    if path not in _OPEN:
        _OPEN[path] = ForcedBoundaryBpe(path)
    return _OPEN[path]


def _texts(column: pa.Array, bpe: ForcedBoundaryBpe):
    """Each text's runs that have tokens, block by block; those of a few rows are learnt together."""
    for at in range(0, len(column), ROWS):
        texts = [raw or b"" for raw in column.slice(at, ROWS).cast(pa.large_binary()).to_pylist()]
        if sum(map(len, texts)) > BLOCK:
            yield from map(bpe.blocks, texts)
            continue
        runs = [raw.split() for raw in texts]
        bpe.learn(itertools.chain.from_iterable(runs))
        for own in runs:
            yield [bpe.speaking(own)]


def _digests(path: str):
    def work(batches):
        bpe = codec(path)
        for b in batches:
            count, ids_sha, text_sha = [], [], []
            for blocks in _texts(b.column(1), bpe):
                n, ids_hash, text_hash, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
                for block in blocks:
                    if not block:
                        continue
                    ids = b"".join(map(bpe.ids.__getitem__, block))
                    n += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(gap + b" ".join(map(bpe.texts.__getitem__, block)))
                    gap = b" "
                count.append(n)
                ids_sha.append(ids_hash.hexdigest())
                text_sha.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return work


def encode_bpe(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every row's whole text."""
    path = path or tokenizer_path()

    def work(batches):
        bpe = codec(path)
        for b in batches:
            ids = [np.frombuffer(bpe.ids_of(blocks), "<u4").astype(np.int32) for blocks in _texts(b.column(1), bpe)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(work, "doc_id long, ids array<int>")


def decode_bpe(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null."""
    path = path or tokenizer_path()

    def work(batches):
        bpe = codec(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _digests(tokenizer_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
