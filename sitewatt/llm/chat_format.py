"""Chat formatting: transcripts parsed by a hidden Markov model over lines, then rendered.

A state is a role, and whether the line starts a turn. A row of the table starts a turn;
inside a text a turn starts only at a line with a speaker marker, so texts that hold
several speakers are split there where that is the likelier reading. Lines are observed by
their marker, length and last character, a text of one turn also by its size and number of
lines (turns inside a text have an even chance for theirs). Start, transition, size and line
tables are smoothed counts of at most ``max_rows`` labelled turns (of the conversations
with the smallest hashed ids); marker chances are fixed parameters, as labelled
turns come without markers.

A row is a matrix: the best log-likelihood of its lines from its first to its last role.
Viterbi over rows is run in chunks of ``CHUNK`` positions, so a conversation of any length,
with any turn numbers, is spread over tasks: each chunk becomes a max-plus matrix (best path
from the state before it to its last state); the matrices of a conversation are chained;
each chunk is then decoded between its known border states, and the lines of a text
between the first and last role its row was given. Positions come from counts: rows that agree
in conversation, turn and text are counted, dealt by ranges of that order and numbered
within a range from the counts of the ranges before. Equal rows are interchangeable, so
only how many of them get a reading matters, and no task holds or orders all of them.

Turns render as ``<|role|>``, the text without its speaker marker, ``<|end|>``.

Defined cases: rows are ordered by turn (null last), then by a hash of the text; null
text is an empty turn; a null conv_id is a conversation of its own; repeated rows are turns each;
an unknown marker is text; without labelled rows all tables are even; an empty table
gives an empty result; the input's role is never read when decoding; columns other
than the named ones are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import materialize

ROLES = ("system", "user", "assistant")
MARKERS = {"system": "system", "sys": "system", "user": "user", "human": "user", "q": "user", "question": "user",
           "assistant": "assistant", "bot": "assistant", "ai": "assistant", "a": "assistant", "answer": "assistant"}
MARKER = re.compile(r"\s*(?:#+\s*|\*\*|<\|)?(%s)(?:\*\*|\|>)?\s*(?:[:>]|(?<=\|>))\s*" % "|".join(sorted(MARKERS, key=len, reverse=True)), re.I)
LINE_KINDS = 16 * 4
TURN_KINDS = 16 * 8
CHUNK = 512
MAX_ROWS = 20_000
MAX_LINES = 100
NONE = -1e300
W = [f"w{a}{b}" for a in range(3) for b in range(3)]
# Chances of a marker: on the first line of a turn its own role's or another's, on a later line any; and of a turn
# starting at a line inside a text.
OWN_MARK, OTHER_MARK, LATER_MARK, INNER = 0.45, 0.0005, 1e-6, 0.02
EVEN = -float(np.log(TURN_KINDS))
MARK_FIRST = np.log(np.array([[1 - OWN_MARK - 2 * OTHER_MARK] + [OWN_MARK if m == r else OTHER_MARK for m in range(3)] for r in range(3)]))
MARK_LATER = np.log(np.array([1 - 3 * LATER_MARK] + [LATER_MARK] * 3))


def marker(line: str):
    """The marker's match and the number of its role (from 1), or None and 0."""
    m = MARKER.match(line)
    return (m, 1 + ROLES.index(MARKERS[m.group(1).lower()])) if m else (None, 0)


def observe(data: np.ndarray, offsets: np.ndarray):
    """Lines of the texts of a chunk: row, marker and kind (length, ending) of each; and each text's kind (size, lines)."""
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, offsets[row + 1], np.append(start[1:], 0) - 1)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    bits = lambda n: np.minimum(15, np.ceil(np.log2(n + 1)).astype(np.int64))
    solid = np.append(-1, np.maximum.accumulate(np.where(tc.SPACES[data], -1, np.arange(len(data)))))
    tail = solid[end]
    ends = np.zeros(len(row), np.int64)
    own = tail >= start
    code = data[tail[own]]
    ends[own] = np.select([code == ord("?"), (code == ord(".")) | (code == ord("!")), code == ord(":")], [1, 2, 3], 0)
    signs = np.append(0, np.cumsum((data == ord(":")) | (data == ord(">"))))
    mark = np.zeros(len(row), np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(signs[end] > signs[start]).tolist():  # a marker ends in one of these
        mark[i] = marker(raw[start[i]:end[i]].decode())[1]
    size = points[offsets[1:]] - points[offsets[:-1]]
    turn = bits(size) * 8 + np.minimum(7, np.bincount(row, minlength=rows) - 1)
    return row, mark, bits(points[end] - points[start]) * 4 + ends, turn


def text_matrix(model, mark, kind, turn) -> np.ndarray:
    """Best log-likelihood of a text's lines from its first role (row) to its last (column)."""
    return _lines(model, mark, kind, turn)[0]


def _lines(model, mark, kind, turn, keep: bool = False):
    """The text's matrix; with ``keep`` also each line's choices, for reading a path back."""
    e = model["line"][:, kind]                                    # role x line
    whole = model["kind"][:, turn] + MARK_FIRST[:, mark[0]] + e.sum(axis=1) + (MARK_LATER[mark[1:]] + np.log(1 - INNER)).sum()
    out = np.full((3, 3), NONE)
    choices = []
    if mark[1:].any():
        one = EVEN + MARK_FIRST[:, mark[0]] + e[:, 0]             # still in the first turn, by its role
        more = np.full((3, 3), NONE)                              # first role x role now, after a split
        for i in range(1, len(mark)):
            go = more + np.log(1 - INNER) + MARK_LATER[mark[i]] + e[None, :, i]
            back = np.full((3, 3), -1)                            # -1: the turn goes on
            if mark[i]:
                here = np.log(INNER) + model["move"] + EVEN + MARK_FIRST[None, :, mark[i]] + e[None, :, i]
                turns = more[:, :, None] + here[None]             # first role x role before x role
                best, at = turns.max(axis=1), turns.argmax(axis=1)
                first = one[:, None] + here
                best, at = np.where(first >= best, first, best), np.where(first >= best, 3, at)  # 3: from the first turn
                back = np.where(best > go, at, -1)
                go = np.maximum(best, go)
            more = go
            one = one + np.log(1 - INNER) + MARK_LATER[mark[i]] + e[:, i]
            choices.append(back)
        out = more
    diag = np.arange(3)
    single = whole >= out[diag, diag]
    out[diag, diag] = np.maximum(out[diag, diag], whole)
    return (out, choices, single) if keep else (out,)


def read_lines(model, mark, kind, turn, first: int, last: int) -> list[tuple[int, int]]:
    """(line, role) of each turn start of a text on its best path from role ``first`` to ``last``."""
    if not mark[1:].any():
        return [(0, first)]
    _, choices, single = _lines(model, mark, kind, turn, True)
    if first == last and single[first] or not choices:
        return [(0, first)]
    starts, role = [], last
    for i in range(len(mark) - 1, 0, -1):
        came = choices[i - 1][first, role]
        if came >= 0:
            starts.append((i, role))
            if came == 3:
                break
            role = int(came)
    return [(0, first), *reversed(starts)]


def _texts(column: pa.Array):
    """Chunks of texts with their lines' observations: first row, raw bytes, offsets, observations."""
    for first, data, offsets in tc.chunks(column, 1 << 20):
        yield first, data, offsets, observe(data, offsets)


def _observations(batches):
    for b in batches:
        kind, lines, ends = [], [], [0]
        for _, _, offsets, (row, _, line, turn) in _texts(b.column(3)):
            kind.append(turn)
            lines.append(line)
            ends += (ends[-1] + np.cumsum(np.bincount(row, minlength=len(offsets) - 1))).tolist()
        flat = pa.array(np.concatenate(lines) if lines else [], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.concatenate(kind) if kind else [], pa.int64()),
                                          pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                                         names=["conv_id", "turn", "role", "kind", "lines"])


def train(turns: DataFrame, max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> dict[str, np.ndarray]:
    """Log tables from at most ``max_rows`` turns with a known role, of each at most its first ``max_lines`` lines."""
    known = turns.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    t = (known.mapInArrow(_observations, "conv_id long, turn long, role string, kind long, lines array<long>")
         .withColumn("lines", F.slice("lines", 1, max_lines))
         .orderBy(F.xxhash64("conv_id"), "conv_id", "turn").limit(max_rows).toArrow())
    start, move = np.ones(3), np.ones((3, 3))
    kind, line = np.full((3, TURN_KINDS), 0.5), np.full((3, LINE_KINDS), 0.5)
    before = (None, None)
    for conv, role, k, lines in zip(*(t[c].to_pylist() for c in ("conv_id", "role", "kind", "lines"))):
        r = ROLES.index(role)
        if before[0] == conv:
            move[before[1], r] += 1
        else:
            start[r] += 1
        kind[r, k] += 1
        np.add.at(line[r], lines, 1)
        before = (conv, r)
    log = lambda c: np.log(c / c.sum(axis=-1, keepdims=True))
    return {"start": log(start), "move": log(move), "kind": log(kind), "line": log(line)}


def _likelihoods(model):
    """Each row's matrix: texts without a marker inside by sums, the others line by line."""
    def work(batches):
        for b in batches:
            seen = np.full((b.num_rows, 3, 3), NONE)
            for first, _, offsets, (row, mark, line, turn) in _texts(b.column(b.num_columns - 1)):
                at = np.searchsorted(row, np.arange(len(offsets)))
                inside = np.ones(len(row), bool)
                inside[at[:-1]] = False
                n = len(offsets) - 1
                later = np.bincount(row, np.where(inside, MARK_LATER[mark] + np.log(1 - INNER), 0), n)
                for r in range(3):
                    seen[first:first + n, r, r] = (model["kind"][r, turn] + MARK_FIRST[r, mark[at[:-1]]]
                                                   + np.bincount(row, model["line"][r, line], n) + later)
                for i in np.unique(row[inside & (mark > 0)]).tolist():
                    own = slice(at[i], at[i + 1])
                    seen[first + i] = text_matrix(model, mark[own], line[own], turn[i])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, seen.reshape(-1, 9).T.copy())], names=b.schema.names[:-1] + W)
    return work


def _ordered(table: pa.Table):
    """A chunk's runs of equal rows in order, and the matrix of each of its rows."""
    table = table.sort_by("at")
    seen = np.column_stack([table[c].to_numpy() for c in W]).reshape(-1, 3, 3)
    return table, np.repeat(seen, table["times"].to_numpy(), axis=0)


def _chunk_matrix(model):
    """Best log-likelihood from each state before the chunk to each last state."""
    def work(table: pa.Table) -> pa.Table:
        table, seen = _ordered(table)
        steps = (model["move"][None, :, :, None] + seen[:, None]).max(axis=2)  # role before x last role of each row
        best, first = steps[0], (model["start"][:, None] + seen[0]).max(axis=0)
        for step in steps[1:]:
            best = (best[:, :, None] + step[None]).max(axis=1)
            first = (first[:, None] + step).max(axis=0)
        return pa.table({"conv": table["conv"][:1], "chunk": table["chunk"][:1],
                         "m": pa.array([np.vstack([best, first]).ravel().tolist()], pa.list_(pa.float64()))})
    return work


def _chain(table: pa.Table) -> pa.Table:
    """State before and at the end of each chunk of one conversation."""
    table = table.sort_by("chunk")
    m = pc.list_flatten(table["m"]).to_numpy().reshape(-1, 4, 3)
    best, back = [m[0, 3]], []
    for x in m[1:]:
        step = best[-1][:, None] + x[:3]
        back.append(step.argmax(axis=0))
        best.append(step.max(axis=0))
    state = int(best[-1].argmax())
    ends = [state]
    for b in reversed(back):
        state = int(b[state])
        ends.append(state)
    ends.reverse()
    return pa.table({"conv": table["conv"], "chunk": table["chunk"], "before": pa.array([-1, *ends[:-1]], pa.int64()),
                     "end": pa.array(ends, pa.int64())})


def _decode(model):
    """How many rows of each run of a chunk get which first and last role, between its border states."""
    def work(table: pa.Table) -> pa.Table:
        table, seen = _ordered(table)
        before, end = table["before"][0].as_py(), table["end"][0].as_py()
        ways = model["move"][None, :, :, None] + seen[:, None]      # row, role before, first role, last role
        steps, firsts = ways.max(axis=2), ways.argmax(axis=2)
        start = (model["start"] if before < 0 else model["move"][before])[:, None] + seen[0]
        best, back = start.max(axis=0), []
        for step in steps[1:]:
            both = best[:, None] + step
            back.append(both.argmax(axis=0))
            best = both.max(axis=0)
        path = [end]
        for x in reversed(back):
            path.append(int(x[path[-1]]))
        path = np.array(path[::-1])
        first = np.append(start.argmax(axis=0)[path[0]], firsts[np.arange(1, len(path)), path[:-1], path[1:]])
        run = np.repeat(np.arange(table.num_rows), table["times"].to_numpy())
        times = np.bincount(run * 9 + first * 3 + path, minlength=table.num_rows * 9)
        some = np.flatnonzero(times)
        return (table.select(["conv", "turn", "th", "salt"]).take(some // 9)
                .append_column("path", pa.array(some % 9)).append_column("times", pa.array(times[some])))
    return work


def _render(model):
    """Each row's turns: part of the text, role, rendered text."""
    def work(batches):
        for b in batches:
            *carried, paths, times, texts = b.columns
            out, path = [], paths.to_numpy()
            for at, data, offsets, (row, mark, line, turn) in _texts(texts):
                raw, edge = data.tobytes(), np.searchsorted(row, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = slice(edge[i], edge[i + 1])
                    starts = read_lines(model, mark[own], line[own], turn[i], *divmod(int(path[at + i]), 3))
                    lines = raw[offsets[i]:offsets[i + 1]].decode().split("\n")
                    turns = []
                    for (lo, role), (hi, _) in zip(starts, [*starts[1:], (len(lines), 0)]):
                        m = marker(lines[lo])[0] if mark[edge[i] + lo] else None
                        body = [lines[lo][m.end():] if m else lines[lo], *lines[lo + 1:hi]]
                        turns.append({"part": lo, "role": ROLES[role], "rendered": f"<|{ROLES[role]}|>\n" + "\n".join(body) + "\n<|end|>"})
                    out.append(turns)
            yield pa.RecordBatch.from_arrays([*carried, times, pa.array(out, _TURNS)], names=[*b.schema.names[:-3], "times", "turns"])
    return work


_TURNS = pa.list_(pa.struct([("part", pa.int64()), ("role", pa.string()), ("rendered", pa.string())]))


def _chunks(seen: DataFrame) -> DataFrame:
    """Runs of equal turns with their position ``at``, cut at borders of CHUNK positions."""
    key = ["conv", "turn", "th"]
    runs = seen.groupBy(*key).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in W])
    # Written, so that both passes see the same ranges.
    runs = materialize(runs.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "chat-runs")
    before = lambda *by: F.sum("n").over(Window.partitionBy(*by[0]).orderBy(*by[1])) - F.col("n")
    parts = runs.groupBy("conv", "part").agg(F.sum("n").alias("n"))  # one row a range
    parts = parts.select("conv", "part", before(["conv"], ["part"]).alias("start"))
    placed = runs.withColumn("own", before(["conv", "part"], ["turn", "th"])).join(parts, ["conv", "part"])
    placed = placed.withColumn("first", F.col("start") + F.col("own")).withColumn("end", F.col("first") + F.col("n"))
    chunk = F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))).alias("chunk")
    at = F.greatest("first", F.col("chunk") * CHUNK)
    return placed.select(*key, "n", "first", "end", *W, chunk).select(
        *key, "chunk", at.alias("at"), (F.least("end", (F.col("chunk") + 1) * CHUNK) - at).alias("times"),
        F.pmod("chunk", _salts()).alias("salt"), *W)


def _salts():
    """Into how many parts the ``n`` equal turns of a run are dealt when they get their text."""
    return F.floor(F.col("n") / CHUNK) + 1


def chat_format(turns: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``conv_id, turn, part, role, rendered``: the turns of every row (conv_id, turn, text); ``part`` is the line a turn starts at."""
    keyed = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv"),
                         F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
                         F.xxhash64("text").alias("th"), "text")
    chunks = _chunks(keyed.mapInArrow(_likelihoods(model), "conv long, turn long, th long, " + ", ".join(f"{c} double" for c in W)))
    matrix = chunks.groupBy("conv", "chunk").applyInArrow(_chunk_matrix(model), "conv long, chunk long, m array<double>")
    border = matrix.groupBy("conv").applyInArrow(_chain, "conv long, chunk long, before long, end long")
    roles = (chunks.join(border, ["conv", "chunk"]).groupBy("conv", "chunk")
             .applyInArrow(_decode(model), "conv long, turn long, th long, salt long, path long, times long"))
    texts = keyed.groupBy("conv", "turn", "th").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    texts = texts.select("conv", "turn", "th", "text", F.explode(F.sequence(F.lit(0).cast("long"), _salts() - 1)).alias("salt"))
    back = lambda c, v: F.when(F.col(c) != F.lit(v), F.col(c)).alias("conv_id" if c == "conv" else c)
    joined = texts.join(roles, ["conv", "turn", "th", "salt"]).select(
        back("conv", -(1 << 63)), back("turn", (1 << 63) - 1), "path", "times", "text")
    shown = joined.mapInArrow(_render(model), "conv_id long, turn long, times long, "
                              "turns array<struct<part: long, role: string, rendered: string>>")
    each = F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("i")
    return shown.select("conv_id", "turn", "turns", each).select("conv_id", "turn", F.inline("turns"))


def op9(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_format(turns, train(turns))
