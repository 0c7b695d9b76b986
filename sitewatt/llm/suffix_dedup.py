"""Byte-level de-duplication of repeated strings by suffix arrays (linear grouping).

Removes each byte covered by a string of ``WINDOW`` bytes that also starts earlier
(smaller document id, or same document and earlier start). Candidates come from
``repeats``; parts that share a core are laid end to end and their suffix array is
built by linear grouping (Baier): suffixes are grouped by first symbol; groups are
taken in descending order, and each group moves its members' previous smaller
suffixes into new, higher groups, until each suffix is grouped by its Lyndon prefix; a
second pass emits each group's order from the smallest suffix on, along the same
pointers. Nothing is renamed or solved recursively. Equal windows are neighbours in
the suffix array; all but the earliest are removed.

Defined cases: null text is empty; matches never cross documents; identical rows
(same id, same text) do not remove each other; rows sharing an id with different texts
are ordered by start, then by a hash of the text; a null id comes first; an empty
table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm import repeats
from sitewatt.llm.common import pipeline_stage

WINDOW = 100
SPEC = repeats.Spec(words=False, window=WINDOW, k=50, by_document=False)
SEPARATOR = 0xFE  # like the core mark, no byte of UTF-8 text


def suffix_array(text: bytes) -> list[int]:
    """Start positions of all suffixes of ``text`` in ascending order.

    A suffix that is a prefix of another comes first. Positions are kept in one
    array in group order; a group is named by the index of its first slot.
    """
    n = len(text)
    if n == 0:
        return []
    # A virtual smallest symbol stands before every text symbol's code and ends the text.
    sa = sorted(range(n), key=text.__getitem__)
    slot = [0] * n          # position -> its index in sa
    group = [0] * n         # position -> first index of its group
    size = [0] * (n + 1)    # first index of a group -> members
    head, last = 0, -1
    for i, p in enumerate(sa):
        if text[p] != last:
            head, last = i, text[p]
        slot[p] = i
        group[p] = head
        size[head] += 1
    smaller = [-1] * n      # previous smaller suffix by group, set when a group is done
    start = n
    done = [False] * n
    while start > 0:
        start = group[sa[start - 1]]
        if size[start] == 1:
            p = sa[start]
            done[p] = True
            j = p - 1
            while j >= 0 and done[j]:  # done positions are in this group or a higher one
                j = smaller[j]
            smaller[p] = j
            if j >= 0:
                g = group[j]
                k = size[g]
                if k > 1:  # its pointer moves to a group of its own
                    size[g] = k = k - 1
                    to, at = g + k, slot[j]
                    other = sa[to]
                    sa[to], sa[at] = j, other
                    slot[j], slot[other] = to, at
                    size[to] = 1
                    group[j] = to
            continue
        members = sorted(sa[start:start + size[start]])
        links: dict[int, int] = {}
        for p in members:
            done[p] = True
            j = p - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[p] = j
            if j >= 0:
                links[j] = links.get(j, 0) + 1
        if len(links) == 1:
            rounds = [links.keys()]
        else:  # more links of one group mean a larger suffix: those move up first
            by_count: dict[int, list[int]] = {}
            for j, c in links.items():
                by_count.setdefault(c, []).append(j)
            rounds = [by_count[c] for c in sorted(by_count, reverse=True)]
        for moved in rounds:
            heads: dict[int, int] = {}
            for j in moved:  # to the end of its group
                g = group[j]
                k = heads[g] = heads.get(g, 0) + 1
                to, at = g + size[g] - k, slot[j]
                if to != at:
                    other = sa[to]
                    sa[to], sa[at] = j, other
                    slot[j], slot[other] = to, at
            for g, k in heads.items():
                if k < size[g]:
                    size[g] -= k
                    h = g + size[g]
                    size[h] = k
                    for i in range(h, h + k):
                        group[sa[i]] = h
    free = list(range(n))   # first index of a group -> next free slot
    out = [-1] * n
    placed = [False] * n
    j = n - 1               # the suffix after the last one is the empty one, the smallest
    i = 0
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
        if i == n:
            return out
        j = out[i] - 1
        i += 1


def match(doc: list[int], base: list[int], n: list[int], width: int, contents: list[bytes]):
    """Windows (of ``width`` symbols with the core as one) that also start earlier."""
    text = bytes([SEPARATOR]).join(contents)
    owner: list[int] = []
    offset: list[int] = []
    for i, s in enumerate(contents):
        owner += [i] * n[i] + [-1] * (len(s) - n[i] + 1)  # the separator, too
        offset += range(len(s) + 1)
    flags = [[False] * c for c in n]
    seen, group = None, []

    def close():
        if len(group) > 1:
            first = min(group, key=lambda p: (doc[owner[p]], base[owner[p]] + offset[p]))
            for p in group:
                if p != first:
                    flags[owner[p]][offset[p]] = True

    for p in suffix_array(text):
        if owner[p] < 0:
            continue
        window = text[p:p + width]
        if window == seen:
            group.append(p)
        else:
            close()
            seen, group = window, [p]
    close()
    for i, f in enumerate(flags):
        for a, b in repeats.runs(f):
            yield i, a, b


def _cut(emit: str):
    """Apply ranges to texts: digests (``emit`` = "digest") or the shortened text."""
    def work(batches):
        for b in batches:
            *carried, texts, starts, ends = b.columns
            out = []
            for text, a, e in zip(texts.cast(pa.binary()), starts, ends):
                raw = text.as_py()
                whole = raw or b""
                spans = repeats.merge_ranges(a.values.to_numpy(), e.values.to_numpy()) if a.is_valid else []
                kept, last = [], 0
                for s, t in spans:
                    kept.append(whole[last:s])
                    last = t
                kept.append(whole[last:])
                rest = b"".join(kept) if spans else whole
                if emit == "digest":
                    out.append((len(whole), len(whole) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
                else:  # a cut inside a character leaves no broken bytes behind
                    out.append((raw if not spans else rest.decode("utf-8", "ignore").encode(),))
            if emit == "digest":
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            else:
                types, names = (pa.binary(),), ["__cut"]
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            if emit != "digest":
                arrays = [arrays[0].cast(pa.string())]
            yield pa.RecordBatch.from_arrays(carried + arrays, names=b.schema.names[:len(carried)] + names)
    return work


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``__a`` and ``__b``: starts and ends of the byte ranges to remove."""
    ranges = repeats.repeated_ranges(repeats.keyed(docs, doc_id, text), SPEC, match, "suffix")
    return repeats.with_ranges(docs, ranges, doc_id, text)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of what is left, beside the columns of ``docs`` other than the text."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    carried = [c for c in docs.columns if c.lower() not in names and c != text]
    schema = docs.select(*carried).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(
        "kept_sha256", "string")
    return suffix_dedup(docs, doc_id, text).select(*carried, text, "__a", "__b").mapInArrow(_cut("digest"), schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with repeated strings cut out of their texts; a character that a cut splits goes whole."""
    schema = docs.drop(text).schema.add("__cut", "string")
    out = suffix_dedup(docs, doc_id, text).select(*[c for c in docs.columns if c != text], text, "__a", "__b")
    out = out.mapInArrow(_cut("text"), schema)
    return out.select(*[F.col("__cut").alias(text) if c == text else F.col(c) for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    from sitewatt.llm.common import documents
    return digests(documents(spark, sf_dir).select("doc_id", "text"))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated strings are cut out, ``n_chars`` follows; every row stays."""
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
