"""Forced-boundary BPE against the library itself."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import cases
from sitewatt.llm import bpe_fragments as B


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(B.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def untidy():
    r = random.Random(5)
    marks = ["don't", "''s", "'S", "it's.'re", "x'll've", "12ab34", "a--b", "<|endoftext|>", "a<|endoftext|><|startoftext|>b",
             "<|EndOfText|>", "é", "é", "́x", "ΣΑΣ", "İ", "ﬁ", "日本語。テスト", "a b", "　", "​", "\x1c", "\x85",
             "“quoted”—", "Ⅷ²½", "👩‍👩‍👧", "</w>", "a</w>b", "�", "ǅ", "한국어", "가", "क्षि", "A" * 300, "zq" * 200,
             "QmFzZTY0" * 40, "≠", "ſ'ſ", "K"]
    rows = [(i, " ".join(r.choice(marks) for _ in range(r.randint(1, 30)))) for i in range(60)]
    rows += [(100 + i, "".join(r.choice(marks) for _ in range(r.randint(1, 30)))) for i in range(60)]
    rows += [(200 + i, "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(9, 14)])) for _ in range(80)))
             for i in range(100)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "  　"), (304, "a\n\n" * 2000), (None, "null id"), (305, "dup"), (305, "dup")]
    return rows + cases.corpus()


def expected(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_query_equals_library(spark, library, scratch):
    rows = untidy()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids_sha256 string")
    df.write.parquet(f"{scratch}/documents.parquet")
    assert by_key(B.op13(spark, scratch).collect()) == by_key(expected(library, rows))


def test_round_trip(spark, library):
    rows = untidy()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_key(B.decode_bpe(B.encode_bpe(df)).collect())
    assert got == by_key((d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in rows)


def test_long_text_in_blocks(library, monkeypatch):
    text = " ".join(t or "" for _, t in untidy() * 3)
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(B, "BLOCK", 1000)
    monkeypatch.setattr(B, "TABLE", 50)
    assert B.ForcedBoundaryBpe(B.tokenizer_path()).encode(text.encode()) == want


def test_cuts_split_words(library):
    bpe = B.codec(B.tokenizer_path())
    parts = bpe.cuts("zqjxhello")
    assert len(parts) > 1 and "".join(parts) == "zqjxhello"


def test_empty_table(spark, scratch):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    assert B.op13(spark, scratch).collect() == []
