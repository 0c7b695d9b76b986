"""N-gram Jaccard join: prefix trees over globally ordered shingle sets.

A document's set holds the hashes of its distinct word n-grams in ascending order (the
global order). Documents link when 100 * intersection >= percent * union.

*Distribution.* Equal sets are one node. Two sets of sizes a <= b that link differ in
at most d = (a + b)(100 - percent) / (100 + percent) elements. Dealing elements to
d + 1 parts by hash leaves at least one part equal in both, so linked sets share
the hash of a part (part counts depend on a size class; a set near a class's lower
end also takes part in the class below). A candidate group belongs to the smallest
node of some part hash and holds every node that shares such a part with it, so all
nodes of a part are in one group and no group grows by chains of parts. Everything
else is out without being compared.

*Join.* Within a candidate group sets are stored in a trie (common prefixes once). Each
set walks the trie with the overlap so far, shared by all sets below a branch;
a branch is left when its lengths cannot fit or when the overlap plus what can still
follow (on either side) cannot reach the threshold. Sets already connected are not
compared again, so a group of near copies costs a row of links, not all pairs.
Groups of more than BLOCK nodes are joined in salted blocks, each with the group's
smallest node and PIVOTS others, which tie the blocks together; only pieces still apart are
compared across blocks.

Defined cases: null text or text without words has an empty set, linked with
nothing; fewer words than n: the whole word sequence is the one element; rows sharing
an id are one document with several sets; a null id counts as the smallest and
gives a null component_id; an empty table gives an empty result; other columns are
carried along, columns named like a result replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm import textcodes as tc
from sitewatt.llm.common import WORD, materialize, pipeline_stage
from sitewatt.llm.components import components

BLOCK = 256
PIVOTS = 8
CELL = 4096
CELL_BYTES = 16 << 20
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """Row and hash of each row's distinct n-grams, by row, ascending."""
    s, e, before = tc.words(data, offsets)
    prefix = tc.prefix_hash(tc.word_hashes(tc.lower_ascii(data), s, e))
    count = np.diff(before)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), grams)
    start = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    h = tc.range_hash(prefix, start, np.minimum(start + n, before[row + 1]))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _size_classes(limit: int) -> np.ndarray:
    """Lower ends of the size classes, each half as large again as the one before."""
    ends = [1]
    while ends[-1] <= limit:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return np.array(ends, np.int64)


def _signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int):
    """(row, part hash) such that rows that link share at least one."""
    ends = _size_classes(int(size.max(initial=1)) + 1)
    top = np.append(ends[1:], ends[-1] * 2) - 1  # largest smaller set of each class
    differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    parts = differ + 3 + differ // 12  # one more than may differ, and some for parts that get no element
    own = np.searchsorted(ends, size, "right") - 1
    low = -(-size * percent // 100)  # smallest set that can link with this one
    rows, sigs = [], []
    for down in (0, 1):
        cls = own - down
        takes = (size > 0) & (cls >= 0)
        if down:
            takes &= low < ends[np.maximum(own, 0)]
        if not takes.any():
            continue
        m = np.where(takes, parts[np.maximum(cls, 0)], 0)
        at = np.cumsum(m) - m
        use = takes[row]
        r, x = row[use], tc.mix(h[use] ^ (cls[row[use]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        slot = at[r] + (x % m[r].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, slot, tc.mix(x))
        held = np.zeros(len(total), bool)
        held[slot] = True
        of = np.repeat(np.arange(len(size)), m)
        index = np.arange(len(total)) - at[of]
        # Elements that may differ; as the smaller set of a pair, or as the larger one.
        differ = np.maximum((size + size * 100 // percent), 2 * size) * (100 - percent) // (100 + percent)
        empty = m - np.bincount(of[held], minlength=len(size))
        keep = held | (empty >= m - differ)[of]  # empty parts count only where full ones may not suffice
        sig = tc.mix(total + tc.mix(index.astype(np.uint64) * np.uint64(64) + cls[of].astype(np.uint64) + np.uint64(1)))
        rows.append(of[keep])
        sigs.append(sig[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray):
    """Parity sketches of sets given as (row, element): 64-bit words laid end to end, and the words of each row.

    A sketch has the power of two of bits from twice the set's size on, at least 64; the lower
    bits of an element's hash name its bin, so a sketch folds to one of half the bits.
    """
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64))
    count = np.where(size > 0, bits >> 6, 0)
    at = np.cumsum(count) - count
    x = tc.mix(h ^ np.uint64(0xA0761D6478BD642F)) & (bits[row] - 1).astype(np.uint64)
    out = np.zeros(int(count.sum()), np.uint64)
    np.bitwise_xor.at(out, at[row] + (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    return out, count


def near_pairs(size: np.ndarray, sketch: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs whose sketches let them link connect."""
    size = np.asarray(size, np.int64)
    length = np.array([len(x) for x in sketch], np.int64)
    piece, found = np.arange(len(size)), []
    for width in np.unique(length):
        # Sets of this width, then longer ones, folded, that are small enough to link with one of them.
        own = np.flatnonzero(length == width)
        own = own[np.argsort(size[own], kind="stable")]
        longer = np.flatnonzero((length > width) & (size * percent <= 100 * size[own[-1]]))
        longer = longer[np.argsort(size[longer], kind="stable")]
        folded = [np.bitwise_xor.reduce(sketch[k].reshape(-1, width), axis=0) for k in longer]
        at = np.concatenate([own, longer])
        bits = np.stack([sketch[k] for k in own] + folded)
        sizes = size[at]  # ascending: longer sketches are of larger sets
        for i in range(len(own)):
            end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
            if end <= i + 1:
                continue
            differ = np.bitwise_count(bits[i + 1:end] ^ bits[i]).sum(axis=1, dtype=np.int64)
            may = (100 + percent) * differ <= (100 - percent) * (sizes[i] + sizes[i + 1:end])
            for j in at[i + 1:end][may].tolist():
                if piece[j] != piece[at[i]]:
                    found.append((j, int(at[i])))
                    piece[piece == piece[j]] = piece[at[i]]
    return found


def _sizes(n: int):
    def work(batches):
        for b in batches:
            out, words, lengths = [[], [], []], [], []
            for _, data, offsets in tc.chunks(b.column(1)):
                row, h = shingle_sets(data, offsets, n)
                k = len(offsets) - 1
                size = np.bincount(row, minlength=k)
                out[0].append(size)
                for c, x in ((1, tc.mix(h)), (2, tc.mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
                    total = np.zeros(k, np.uint64)
                    np.add.at(total, row, x)
                    out[c].append(total.view(np.int64))
                bits, count = sketches(row, h, size)
                words.append(bits)
                lengths.append(count)
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
            ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *lengths])) * 8
            data = np.concatenate([*words, np.zeros(0, np.uint64)]).astype("<u8")
            sketch = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, sketch], names=["doc", "size", "h1", "h2", "sketch"])
    return work


def _sig_rows(n: int, percent: int):
    def work(batches):
        for b in batches:
            for _, data, offsets in tc.chunks(b.column(0)):
                row, h = shingle_sets(data, offsets, n)
                k = len(offsets) - 1
                total = np.zeros(k, np.uint64)
                np.add.at(total, row, tc.mix(h))
                r, sig = _signatures(row, h, np.bincount(row, minlength=k), percent)
                yield pa.RecordBatch.from_arrays([tc.signed(sig), pa.array(total.view(np.int64)[r])], names=["sig", "set"])
    return work


def _with_texts(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """``dealt`` (node and any long columns) with the texts of each node.

    Groups receive texts, not sets: a text is smaller than its elements.
    """
    keys = [c for c in dealt.columns if c != "node"]
    rows = docs.join(dealt.withColumnRenamed("node", "doc").hint("shuffle_hash"), "doc")
    return rows.select(F.col("doc").alias("node"), *keys, "text")


class _Trie:
    """Sorted sets as a path-compressed prefix tree: node i covers sets [lo, hi)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.nodes: list[tuple] = []
        self.children: list[list[int]] = []
        if sets:
            self._build()

    def _build(self):
        sets = self.sets
        todo = [(0, len(sets), 0, -1)]
        while todo:
            lo, hi, d0, parent = todo.pop()
            a, z = sets[lo], sets[hi - 1]
            m = min(len(a), len(z))
            differ = np.flatnonzero(a[d0:m] != z[d0:m])
            d1 = d0 + int(differ[0]) if len(differ) else m
            sizes = [len(s) for s in sets[lo:hi]]
            k = len(self.nodes)
            leaf = hi - lo == 1 or d1 == len(z)
            self.nodes.append((lo, hi, d0, len(a) if leaf else d1, min(sizes), max(sizes), leaf))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(k)
            if leaf:
                continue
            i = lo
            while i < hi and len(sets[i]) == d1:  # sets that end here
                i += 1
            if i > lo:
                todo.append((lo, i, d1, k))
            while i < hi:
                t, j = sets[i][d1], i + 1
                while j < hi and sets[j][d1] == t:
                    j += 1
                todo.append((i, j, d1, k))
                i = j

    def arrays(self, code: np.ndarray, start: np.ndarray) -> "_Walk":
        return _Walk(self, code, start)


class _Walk:
    """The trie as arrays, walked a level at a time."""

    def __init__(self, trie: _Trie, code: np.ndarray, start: np.ndarray):
        cols = np.array([n[:6] for n in trie.nodes], np.int64).reshape(-1, 6).T
        self.lo, self.hi, d0, self.depth, self.least, self.most = cols
        self.leaf = np.array([n[6] for n in trie.nodes], bool)
        self.length = self.depth - d0
        self.edges = code[_ranges(start[self.lo] + d0, self.length)]      # the nodes' own elements, end to end
        self.at = np.cumsum(self.length) - self.length
        self.some = np.flatnonzero(self.length)
        last = start[self.lo] + self.depth - 1
        self.last = np.where(self.depth > 0, code[np.maximum(last, 0)] if len(code) else 0, -1)
        count = np.array([len(c) for c in trie.children], np.int64)
        self.count, self.first = count, np.cumsum(count) - count
        self.child = np.array([k for c in trie.children for k in c], np.int64)

    def walk(self, i: int, own: np.ndarray, mark: np.ndarray, size: np.ndarray, piece: np.ndarray, percent: int) -> np.ndarray:
        """Earlier sets of other pieces that set ``i`` links with. Overlaps with the nodes' own elements are summed along the branches, a branch is
        left when its sizes cannot fit or its overlap and what can still follow cannot reach the threshold."""
        a, out = len(own), []
        hits = np.zeros(len(self.lo), np.int64)
        if len(self.some):
            hits[self.some] = np.add.reduceat(mark[self.edges], self.at[self.some], dtype=np.int64)
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            lo, least, most = self.lo[nodes], self.least[nodes], self.most[nodes]
            go = (lo < i) & (100 * most >= percent * a) & (100 * a >= percent * least)
            go &= ~((self.hi[nodes] - lo == 1) & (piece[lo] == piece[i]))
            nodes, overlap = nodes[go], overlap[go]
            overlap = overlap + hits[nodes]
            leaf = self.leaf[nodes]
            ends, both = nodes[leaf], overlap[leaf]
            members = np.minimum(self.hi[ends], i) - self.lo[ends]
            j = _ranges(self.lo[ends], members)
            linked = (100 + percent) * np.repeat(both, members) >= percent * (a + size[j])
            out.append(j[linked & (piece[j] != piece[i])])
            nodes, overlap = nodes[~leaf], overlap[~leaf]
            left = a - np.searchsorted(own, self.last[nodes], "right")
            rest = np.minimum(left, self.most[nodes] - self.depth[nodes])
            go = (100 + percent) * (overlap + rest) >= percent * (a + np.maximum(self.least[nodes], self.depth[nodes]))
            nodes, overlap = nodes[go], overlap[go]
            overlap = np.repeat(overlap, self.count[nodes])
            nodes = self.child[_ranges(self.first[nodes], self.count[nodes])]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for ``size`` numbers each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def trie_join(ids: list, sets: list[np.ndarray], percent: int, same: list | None = None) -> list[tuple]:
    """Links (id, id) that connect exactly what all links within the group connect.

    ``same``: pieces known before; links inside one piece are left out.
    """
    order = sorted(range(len(ids)), key=lambda i: sets[i].astype(">u8").tobytes())
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    piece = list(range(len(ids)))
    if same is not None:
        first: dict = {}
        piece = [first.setdefault(same[i], k) for k, i in enumerate(order)]

    piece = np.array(piece, np.int64)
    size = np.array([len(x) for x in sets], np.int64)
    # Elements as numbers in their order, so that a set's own are marked in one table.
    code = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    trie, links = _Trie(sets).arrays(code, ends - size), []
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    for i in range(len(sets)):
        own = code[ends[i] - size[i]:ends[i]]
        if not len(own):
            continue
        mark[own] = True
        found = trie.walk(i, own, mark, size, piece, percent)
        mark[own] = False
        for j in found.tolist():
            if piece[j] != piece[i]:
                links.append((ids[j], ids[i]))
                piece[piece == piece[i]] = piece[j]
    return links


def _join_group(n: int, percent: int, labelled: bool):
    def work(table: pa.Table) -> pa.Table:
        sets = []
        for _, data, offsets in tc.chunks(table["text"]):
            row, h = shingle_sets(data, offsets, n)
            sets += np.split(h, np.searchsorted(row, np.arange(1, len(offsets) - 1)))
        links = trie_join(table["node"].to_pylist(), sets, percent, table["label"].to_pylist() if labelled else None)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})
    return work


def _near_group(percent: int):
    def work(table: pa.Table) -> pa.Table:
        sketch = [np.frombuffer(x, "<u8") for x in table["sketch"].to_pylist()]
        node = table["node"].to_numpy()
        pairs = np.array(near_pairs(table["words"].to_numpy(), sketch, percent), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(node[pairs[:, 0]], pa.int64()), "v": pa.array(node[pairs[:, 1]], pa.int64())})
    return work


def _near(reps: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that connect what all pairs of a candidate group that may link connect.

    A group of more than one block is dealt to cells, in which each two of its blocks meet once.
    """
    k = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("words") / 2 / CELL_BYTES))  # at most half a byte an element
    large = materialize(member.groupBy("cand").agg(k.alias("k")).filter("k > 1"), "ngram-groups")
    x = member.join(large, "cand", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    x = x.withColumn("s", F.pmod(F.xxhash64("h1", "h2"), F.col("k")))
    cells = F.transform(F.expr("sequence(0L, k - 1)"), lambda o: F.struct(F.greatest("s", o).alias("o"), F.least("s", o).alias("p")))
    x = x.select("cand", "h1", "h2", F.explode(cells).alias("cell")).select("cand", "h1", "h2", "cell.o", "cell.p")
    x = x.join(reps, ["h1", "h2"]).select("cand", "o", "p", "node", "words", "sketch")
    return x.groupBy("cand", "o", "p").applyInArrow(_near_group(percent), "u long, v long")


def _in_blocks(member: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of each candidate group by salted block; its pivots are in every block."""
    x = member.join(sizes, "cand").withColumn("k", F.ceil(F.col("size") / BLOCK))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("k")))
    salts = F.when((F.col("k") > 1) & F.array_contains("pivots", F.col("node")), F.expr("sequence(0L, k - 1)")).otherwise(own)
    return x.select("node", "words", "cand", F.explode(salts).alias("salt"))


def _labels(member: DataFrame, links: DataFrame) -> DataFrame:
    label = components(links, "pieces")
    return member.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _across(member: DataFrame) -> DataFrame:
    """Cells that bring together pieces of one candidate group from different blocks.

    The group's largest piece is dealt to blocks, and so are the others; each block
    of the others meets each block of the largest and of the others once. A group of one
    block's size is one cell.
    """
    pieces = member.groupBy("cand", "label").agg(F.count("*").alias("n"))
    main = pieces.groupBy("cand").agg(F.max(F.struct("n", F.col("label"))).alias("m"), F.sum("n").alias("size"))
    main = main.select("cand", F.col("m.label").alias("main"), F.ceil(F.col("m.n") / BLOCK).alias("mk"), "size",
                       F.ceil((F.col("size") - F.col("m.n")) / BLOCK).alias("ok")).filter("ok > 0")
    x = member.join(main, "cand").withColumn("is_main", F.col("label") == F.col("main"))
    x = x.withColumn("salt", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mk")).otherwise(F.col("ok"))))
    others = F.expr("sequence(0L, ok - 1)")
    here = F.array(F.struct(F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("p")))
    cells = (F.when(F.col("size") <= BLOCK, here).when(F.col("is_main"), F.transform(others, lambda o: F.struct(o.alias("o"), (-1 - F.col("salt")).alias("p"))))
             .otherwise(F.concat(
                 F.transform(F.expr("sequence(0L, mk - 1)"), lambda m: F.struct(F.col("salt").alias("o"), (-1 - m).alias("p"))),
                 F.transform(others, lambda o: F.struct(F.greatest("salt", o).alias("o"), F.least("salt", o).alias("p"))))))
    return (x.select("node", "words", "cand", "label", F.explode(cells).alias("cell"))
            .select("node", "words", "cand", "label", "cell.o", "cell.p"))


def _compare(keyed: DataFrame, dealt: DataFrame, by: list[str], join, corpus: int) -> DataFrame:
    """Links inside the groups ``by`` of ``dealt`` (node, ``words`` and the group's columns), joined by ``join``.

    Texts are sent in passes over disjoint groups, each of about as many words as the whole
    corpus holds, however often a text is wanted: a pass's shuffle files go when its links are written.
    """
    passes = -(-(dealt.agg(F.sum("words")).first()[0] or 0) // max(corpus, 1))
    found = []
    for k in range(max(1, passes)):
        some = dealt.filter(F.pmod(F.xxhash64(*by), F.lit(max(1, passes))) == k).drop("words")
        links = _with_texts(keyed, some).groupBy(*by).applyInArrow(join, "u long, v long")
        found.append(materialize(links, "ngram-links"))
    return functools.reduce(DataFrame.union, found)


def _links(keyed: DataFrame, member: DataFrame, n: int, percent: int, corpus: int) -> DataFrame:
    """Links that connect what all links inside the groups ``cand`` connect; ``keyed`` holds their nodes' texts."""
    sizes = member.groupBy("cand").agg(F.count("*").alias("size"), F.array_distinct(F.array_compact(F.array(
        F.min(F.when(F.col("low"), F.col("node"))),
        *[F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)) == r, F.col("node"))) for r in range(PIVOTS)]))).alias("pivots"))
    sizes = materialize(sizes, "ngram-groups")
    member = member.drop("low")
    links = _compare(keyed, _in_blocks(member, sizes), ["cand", "salt"], _join_group(n, percent, False), corpus)
    large = sizes.filter(F.col("size") > BLOCK).select("cand")
    if large.isEmpty():  # every group was one block: all its links are found
        return links
    big = _labels(member.join(large, "cand", "left_semi"), links)
    return links.union(_compare(keyed, _across(big), ["cand", "o", "p"], _join_group(n, percent, True), corpus))


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``(doc, size, component)``, one row per row of ``docs`` (doc: the id, null as NO_ID)."""
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    rows = materialize(keyed.mapInArrow(_sizes(n), "doc long, size long, h1 long, h2 long, sketch binary"), "ngram-sizes")
    reps = materialize(rows.filter("size > 0").groupBy("h1", "h2").agg(
        F.min("doc").alias("node"), F.max("size").alias("words"), F.first("sketch").alias("sketch")), "ngram-nodes")
    rows = rows.drop("sketch")

    sigs = keyed.select("text").mapInArrow(_sig_rows(n, percent), "sig long, set long")
    shared = sigs.groupBy("sig").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low < high")
    shared = materialize(shared.select("sig", "low"), "ngram-shared")
    star = sigs.join(shared, "sig").select(F.col("low").alias("cand"), F.col("set").alias("h1")).distinct()
    member = materialize(reps.join(star, "h1").select("h1", "h2", "words", "cand"), "ngram-members")
    near = components(_near(reps, member, percent), "ngram-near")
    member = reps.groupBy("node").agg(F.sum("words").alias("words")).join(near, "node").select(
        "node", "words", F.col("label").alias("cand"), (F.col("node") == F.col("label")).alias("low"))
    member = materialize(member, "ngram-groups")
    texts = keyed.join(member.select(F.col("node").alias("doc")), "doc", "left_semi")
    links = _links(materialize(texts, "ngram-texts"), member, n, percent, rows.agg(F.sum("size")).first()[0] or 0)

    reps = reps.drop("words", "sketch")
    nodes = rows.filter("size > 0").join(reps, ["h1", "h2"])
    several = nodes.groupBy("doc").agg(F.min("node").alias("u"), F.max("node").alias("w")).filter("u < w").select("doc", "u")
    same_id = nodes.join(several, "doc").select("u", F.col("node").alias("v")).filter("u <> v")
    label = components(links.union(same_id), "ngram-components").select("node", F.col("label").alias("found"))
    own = rows.join(reps.hint("shuffle_hash"), ["h1", "h2"], "left").join(label, "node", "left")
    return own.select("doc", "size", F.when(F.col("size") == 0, F.col("doc")).otherwise(
        F.coalesce("found", "node")).alias("component"))


def op5(spark, sf_dir: str) -> DataFrame:
    from sitewatt.llm.common import documents
    out = ngram_join(documents(spark, sf_dir))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(null("doc").alias("doc_id"), F.col("size").alias("n_shingles"), null("component").alias("component_id"))


@pipeline_stage
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group (5-word shingles, 0.8) the row of the smallest id (null first), then text hash, stays.

    A document is an (id, text) here: texts that share an id are not one document, copies
    of a row are; rows without id and words are documents of their own.
    """
    alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    rows = docs.filter(~alone).withColumn("__row", row)
    found = ngram_join(rows, "__row", n=5, percent=80).select(F.col("doc").alias("__row"), "component").distinct()
    own = rows.select("__row", F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).distinct()
    first = own.join(found, "__row").groupBy("component").agg(F.min(F.struct("id", "th", "__row")).alias("first"))
    one = rows.groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("one"))
    kept = one.join(first.select("first.__row"), "__row", "left_semi").select("one.*")
    return kept.unionByName(docs.filter(alone))
