"""Secret scans: base patterns and dictionary-primed zstandard novelty.

Base spans are fixed patterns. The method adds ``novel`` spans: every token of
MIN_TOKEN or more in a sensitive context (a keyword within SURROUND code points on
either side, or in a run of adjacent long tokens one of which has such a keyword: the
lines of a key, dotted or wrapped parts) is measured, whatever its characters, by its
marginal compressed size; what base spans cover of a token is left out. The compressor is primed with a raw dictionary made of the
identifier dictionary and the code around the candidate; the marginal size is
what the frame grows by when the candidate is added to an empty one. Names,
words and repeated code cost little, random strings cost nearly all their
entropy; those at or above the ratio are reported.

Defined cases: null text is empty (no spans); offsets count code points, the end
is exclusive; repeated rows are scanned each; an empty table gives an empty
result; other columns are carried along, columns named like a result replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import pipeline_stage

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
MIN_ASSIGN, MIN_HEX = 6, 24

#: Words around which a long token is suspicious.
CONTEXT = re.compile(r"(?:passw|secret|token|api_?key|credential|private|auth|bearer|signature|access_?key|client_?id)", re.I | re.A)
CONTEXT_HINTS = ASSIGN_HINTS + (b"credential", b"private", b"auth", b"bearer", b"signature", b"accesskey", b"access_key",
                                b"clientid", b"client_id")
MIN_TOKEN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
GAP = re.compile(r"(?:\\[nrt]|[\W_])*")  # between tokens of one run: line ends, dots, quotes, operators
SURROUND = 400      # code points on either side: they hold the keyword and prime the compressor
MIN_RATIO = 0.62    # marginal compressed bytes per byte of the candidate
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key client_id client_secret private_key public_key authorization "
    "bearer authentication credential signature username user_name database connection configuration environment "
    "production development function return import export class public private static const string integer boolean "
    "response request session cookie header content application service account storage encoding description value "
    "https://www. http:// .com/ .org/ localhost 127.0.0.1 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789 0000000000000000 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX ---------------- ================ ________________")


def _hex_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal [0-9a-f] runs of MIN_HEX or more."""
    is_hex = np.zeros(len(data) + 2, np.int8)
    is_hex[1:-1] = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    edge = np.diff(is_hex)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - start >= MIN_HEX
    return start[keep], end[keep]


def novelty(candidate: bytes, before: bytes, after: bytes, level: int = 3) -> float:
    """Marginal compressed bytes per byte, primed with identifiers and surroundings."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + b"\n" + after + b"\n" + before,
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False,
                                 write_dict_id=False)
    tail = b" ;\n"
    return (len(z.compress(candidate + tail)) - len(z.compress(tail))) / max(1, len(candidate))


def _candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Long tokens, without the base spans in them, that a keyword or their run makes suspicious."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return []
    starts, ends = np.array(words).T
    tokens = [m.span() for m in TOKEN.finditer(text)]
    near = [bool(np.searchsorted(ends, e + SURROUND, "right") > np.searchsorted(starts, s - SURROUND)) for s, e in tokens]
    run = [0] * len(tokens)
    for i in range(1, len(tokens)):
        run[i] = run[i - 1] + (not GAP.fullmatch(text, tokens[i - 1][1], tokens[i][0]))
    sensitive = {r for r, x in zip(run, near) if x}
    out, taken, k = [], sorted(taken), 0
    for (s, e), r in zip(tokens, run):
        if r not in sensitive:
            continue
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < e:
            if taken[j][0] - s >= MIN_TOKEN:
                out.append((s, taken[j][0]))
            s, j = max(s, taken[j][1]), j + 1
        if e - s >= MIN_TOKEN:
            out.append((s, e))
    return out


def _novel(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(s, e) for s, e in _candidates(text, taken) if MIN_RATIO <= novelty(
        text[s:e].encode(), text[max(0, s - SURROUND):s].encode(), text[e:e + SURROUND].encode())]


def scan(text: str, data: bytes, hex_runs) -> dict[str, list[tuple[int, int]]]:
    """Spans of one text by kind, in code points. ``hex_runs``: byte ranges."""
    low = data.lower()
    spans = {k: [] for k in KINDS}
    if any(h in low for h in ASSIGN_HINTS):
        spans["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
    if b"AKIA" in data:
        spans["access"] = [m.span() for m in ACCESS.finditer(text)]
    at = points = 0  # bytes and code points before the run: counted once, from run to run
    for s, e in hex_runs:
        points += len(data[at:s].decode())
        spans["hex"].append((points, points + int(e - s)))
        at, points = e, points + int(e - s)
    if any(h in low for h in CONTEXT_HINTS):
        spans["novel"] = _novel(text, spans["assign"] + spans["access"] + spans["hex"])
    return spans


def render(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    rows = sorted((s, i, e, k) for i, k in enumerate(KINDS) if k in kinds for s, e in spans[k])
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in rows)


RESULT = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _scan_batch(texts: pa.Array) -> list[tuple]:
    out = []
    for _, data, offsets in tc.chunks(texts):
        raw = data.tobytes()
        hs, he = _hex_runs(data)
        row = np.searchsorted(offsets, hs, "right") - 1
        runs: dict[int, list] = {}
        for r, s, e in zip(row.tolist(), hs.tolist(), he.tolist()):
            while s < e:  # a run may go on into the next rows
                stop = min(e, int(offsets[r + 1]))
                if stop - s >= MIN_HEX:
                    runs.setdefault(r, []).append((s - int(offsets[r]), stop - int(offsets[r])))
                s, r = stop, r + 1
        low = raw.lower()
        busy = any(h in low for h in CONTEXT_HINTS) or b"AKIA" in raw
        for r in range(len(offsets) - 1):
            if not busy and r not in runs:
                out.append((0, 0, 0, 0, _EMPTY_SHA, ""))
                continue
            own = raw[offsets[r]:offsets[r + 1]]
            spans = scan(own.decode(), own, runs.get(r, ()))
            base = render(spans, KINDS[:3])
            out.append((*(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), render(spans)))
    return out


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Span counts, the digest of the base spans and all spans, beside all columns but the text."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    carried = [c for c in docs.columns if c.lower() not in names and c.lower() != text.lower()]
    df = docs.select(*carried, F.col(text).alias("__scanned"))
    schema = docs.select(*carried).schema
    for f in RESULT.split(", "):
        schema = schema.add(*f.split())

    def work(batches):
        for b in batches:
            cols = _scan_batch(b.column(b.num_columns - 1))
            arrays = [pa.array([c[i] for c in cols], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(carried))] + arrays, names=carried + names)

    return df.mapInArrow(work, schema)


def mask(text: str | None, spans: str, sign: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones merged) replaced by ``sign``."""
    if not text or not spans:
        return text
    merged: list[list[int]] = []
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, last = [], 0
    for s, e in merged:
        out += [text[last:s], sign]
        last = e
    return "".join(out) + text[last:]


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace found secrets in the text; columns and rows stay as they are."""
    schema, at = docs.schema, docs.columns.index(text)

    def work(batches):
        for b in batches:
            texts = b.column(at)
            found = _scan_batch(texts)
            if any(f[5] for f in found):
                new = [mask(t, f[5]) if f[5] else t for t, f in zip(texts.to_pylist(), found)]
                arrays = [pa.array(new, texts.type) if i == at else b.column(i) for i in range(b.num_columns)]
                b = pa.RecordBatch.from_arrays(arrays, names=b.schema.names)
            yield b

    return docs.mapInArrow(work, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    from sitewatt.llm.common import documents
    return secret_scan(documents(spark, sf_dir).select("doc_id", "text"))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are masked in the text, ``n_chars`` follows."""
    out = mask_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
