"""Word-level substring de-duplication by relative Lempel-Ziv parsing.

Removes each word covered by a window of ``WINDOW`` words whose word sequence also
starts in a document with a smaller id. ``repeats`` finds the places that can hold
such windows and groups them by shared cores. In a group the contents are parsed
in order of their documents: each becomes a row of greedy factors against the index
of all reference blocks before it (contents whose document is smaller). A
factor starts where a whole window stands in a block and runs on as long as the next
word agrees with that block. Behind a factor's end the windows across the
boundary are looked up again, against every block, so a repeat that two
factors share is not missed. Factors of at least one window are the removed spans.

Defined cases: words are runs of characters other than space and \\t to \\r,
unchanged; null text has no words; rows sharing an id never remove each other; a null
id counts as the smallest; an empty table gives an empty result; other columns are
carried along, columns named like a result replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitewatt.llm import repeats
from sitewatt.llm import textcodes as tc

WINDOW = 50
SPEC = repeats.Spec(words=True, window=WINDOW, k=25, by_document=True)
SYMBOL = 8  # bytes of a word code


def factors(doc: list[int], n: list[int], width: int, contents: list[bytes]):
    """Greedy factors (content, first window, windows, block, window in the block)."""
    size = width * SYMBOL
    index: dict[bytes, tuple[int, int]] = {}
    for i in sorted(range(len(doc)), key=doc.__getitem__):
        s, j = contents[i], 0
        while j < n[i]:
            hit = index.get(s[j * SYMBOL:j * SYMBOL + size])
            if hit is None or doc[hit[0]] >= doc[i]:
                j += 1
                continue
            block, at = hit
            t, length = contents[block], 1
            while j + length < n[i] and at + length < n[block]:
                x, y = (j + length - 1) * SYMBOL + size, (at + length - 1) * SYMBOL + size
                if s[x:x + SYMBOL] != t[y:y + SYMBOL]:
                    break
                length += 1
            yield i, j, length, block, at
            j += length
        for j in range(n[i]):
            index.setdefault(s[j * SYMBOL:j * SYMBOL + size], (i, j))


def match(doc, base, n, width, contents):
    for i, j, length, _, _ in factors(doc, n, width, contents):
        yield i, j, j + length - 1


def _digest(batches):
    for b in batches:
        *carried, texts, starts, ends = b.columns
        raw = texts.cast(pa.binary()).to_pylist()
        out = []
        for first, data, offsets in tc.chunks(texts):
            s, e, before = tc.words(data, offsets)
            joined = data.tobytes()
            for r in range(len(offsets) - 1):
                lo, hi = int(before[r]), int(before[r + 1])
                gone = np.zeros(hi - lo + 1, np.int64)
                a, z = starts[first + r], ends[first + r]
                if a.is_valid:
                    np.add.at(gone, a.values.to_numpy(), 1)
                    np.add.at(gone, z.values.to_numpy(), -1)
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + lo
                if len(keep) == hi - lo:  # whole: splitting is quicker than slicing
                    rest = b" ".join(raw[first + r].split()) if raw[first + r] else b""
                else:
                    rest = b" ".join([joined[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())])
                out.append((hi - lo, hi - lo - len(keep), hashlib.sha256(rest).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(carried + arrays, names=b.schema.names[:len(carried)] + ["n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``__a`` and ``__b``: starts and ends of the word ranges to remove."""
    ranges = repeats.repeated_ranges(repeats.keyed(docs, doc_id, text), SPEC, match, "substring")
    return repeats.with_ranges(docs, ranges, doc_id, text)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the words left, beside the columns of ``docs`` other than the text."""
    names = ["n_words", "n_removed", "kept_sha256"]
    carried = [c for c in docs.columns if c.lower() not in names and c != text]
    schema = docs.select(*carried).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return substring_dedup(docs, doc_id, text).select(*carried, text, "__a", "__b").mapInArrow(_digest, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    from sitewatt.llm.common import documents
    return digests(documents(spark, sf_dir).select("doc_id", "text"))
