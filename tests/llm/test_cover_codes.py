"""Cover-tree Lloyd codes against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from sitewatt.llm import cover_codes as C


def plain(rows):
    """Result rows of (id, vector, label) rows by exhaustive comparison."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    if not least:
        return []
    w = len(kept[0][1]) // 8
    cut = lambda v: [v[p * w:(p + 1) * w] for p in range(8)]
    books = [[cut(least[i])[p] for i in sorted(least)[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (dist(part, book[e]), e))
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                part = cut(v)[p]
                groups.setdefault(nearest(part, books[p]), []).append(part)
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for i, v, lab in kept:
        codes = [nearest(part, books[p]) for p, part in enumerate(cut(v))]
        out.append((i, "".join("%02x" % e for e in codes), sum(dist(part, books[p][codes[p]]) for p, part in enumerate(cut(v))), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, total[lab], sha) for i, c, e, lab in out]


def untidy(seed=1, n=150, dim=16):
    r = np.random.default_rng(seed)
    centres = r.normal(0, .3, (5, dim))
    rows = [(int(i) * 3, (centres[i % 5] + r.normal(0, .05, dim)).astype(np.float32).tolist(), int(r.integers(0, 4)) if i % 7 else None)
            for i in range(n)]
    rows += [rows[0], rows[1], (3, [0.25] * dim, 1), (None, [0.1] * dim, None), (-5, [1.0] * dim, 2), (-4, [1.0] * dim, 2)]
    rows += [(900, None, 1), (901, [None] + [0.5] * (dim - 1), 1), (902, [math.nan] * dim, 1), (903, [math.inf] + [0.0] * (dim - 1), 2)]
    rows += [(1000 + i, [0.5 if i % 2 else -0.5] * dim, 9) for i in range(40)]  # ties and copies
    return rows


def table(spark, rows, folder):
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string")
    df.repartition(5).write.parquet(f"{folder}/embeddings.parquet")


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("rows", [untidy(), untidy(2, 9), [(7, [0.5] * 8, None)], [(1, [0.0] * 8, 1)] * 20], ids=["many", "few", "one", "copies"])
def test_query_equals_plain(spark, scratch, rows):
    table(spark, rows, scratch)
    assert by_key(C.op12(spark, scratch).collect()) == by_key(plain(rows))


def test_small_chunks(spark, scratch, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 1)
    rows = untidy(3, 400)
    table(spark, rows, scratch)
    assert by_key(C.op12(spark, scratch).collect()) == by_key(plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, [0.5] * 8, 1)], [(1, None, 1), (2, [math.nan] * 8, 1)]], ids=["empty", "no id", "no vector"])
def test_nothing_to_code(spark, scratch, rows):
    table(spark, rows, scratch)
    assert C.op12(spark, scratch).collect() == []


def test_lengths_must_agree(spark, scratch):
    table(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], scratch)
    with pytest.raises(Exception, match="lengths"):
        C.op12(spark, scratch)


def test_tree_invariants_and_pruning():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 40, (300, 4)) for c in (-4000, 0, 5000)]).astype(np.int64)
    t = C.Tree.load(C.Tree.build(x).dump())
    assert (np.sort(t.order) == np.arange(len(x))).all() and (t.points == x[t.order]).all()
    for k in range(len(t.lo)):
        own = t.points[t.lo[k]:t.hi[k]]
        assert np.sqrt(C._squares(own, t.points[t.centre[k]]).max()) <= t.radius[k]
        kids = range(t.first[k], t.first[k] + t.count[k])
        assert not kids or (t.lo[kids[0]], t.hi[kids[-1]]) == (t.lo[k], t.hi[k])
        far = int(C._squares(own, t.points[t.centre[k]]).max())
        cover = min(4 ** i for i in range(40) if 4 ** i >= far) / 4
        for a in kids:
            inside = t.points[t.lo[a]:t.hi[a]]
            assert t.lo[a] <= t.centre[a] < t.hi[a] and C._squares(inside, t.points[t.centre[a]]).max() <= cover
            assert all(a == b or C._squares(t.points[t.centre[a]], t.points[t.centre[b]]) > cover for b in kids)
    book = np.array([[-4000] * 4, [0] * 4, [5000] * 4, [0] * 4])
    (n, total), compared = t.assign(book)
    assert n.tolist() == [300, 300, 300, 0] and compared == 0  # whole subtrees, none by single points
    assert total[1].tolist() == x[300:600].sum(axis=0).tolist()
