"""The streaming audit against plain loops, with retractions forced by the order of files."""

import itertools
import os

import cases
import pytest
from sitewatt.llm import interaction_audit as A


def plain(docs, labels):
    """(part, order, step, kept, removed, redundant, unique, good, toxic, shapley) by applying every order."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    fails, part = [], []
    for d, t, lang in docs:
        t = t or ""
        w = cases.words(t)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if d is not None and first[t] < d:
            f.add("E")
        fails.append(f)
        part.append(lang or "")
    out = []
    for p in sorted(set(part)):
        own = [i for i, q in enumerate(part) if q == p]
        removed_by = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for k, f in enumerate(order):
                gone = {i for i in left if f in fails[i]}
                redundant = sum(f in fails[i] for i in own if i not in left)
                left -= gone
                removed_by[f] += len(gone)
                rows.append((p, "".join(order), k + 1, len(left), len(gone), redundant, sum(fails[i] == {f} for i in own),
                             sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone), f))
        out += [r[:-1] + (removed_by[r[-1]],) for r in rows]
    return sorted(out)


def untidy():
    docs = [(i, t, ["en", "de", None, ""][(i or 0) % 4]) for i, t in cases.corpus()]
    copies = [docs[3][1], docs[20][1], "", None]
    docs += [(d, copies[d % 4], "en" if d % 3 else "de") for d in range(500, 460, -1)]  # descending ids
    docs += [(None, docs[3][1], "en"), (None, None, None), (None, "x", "de")] + [(-7, docs[3][1], "fr")] * 2
    labels = [(d, i % 2, i % 3 == 0 and 1 or 0) for i, (d, _, _) in enumerate(docs) if d is not None and i % 2]
    labels += [(3, None, None), (3, 1, 1), (None, 1, 1), (99999, 1, 1)]
    return docs, labels


def write(spark, folder, docs, labels, files):
    """``files`` Parquet files, oldest first holding the largest ids."""
    docs = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    size = -(-len(docs) // files)
    for k in range(files):
        part = docs[k * size:(k + 1) * size]
        spark.createDataFrame([(*r, 1) for r in part], "doc_id long, text string, lang string, mask int").coalesce(1) \
            .write.mode("append").parquet(f"{folder}/documents.parquet")
        for name in os.listdir(f"{folder}/documents.parquet"):
            path = f"{folder}/documents.parquet/{name}"
            if name.endswith(".parquet") and os.path.getmtime(path) > 1e9:
                os.utime(path, (1e8 + k, 1e8 + k))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def rows_of(df):
    return sorted(map(tuple, df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley").collect()))


@pytest.mark.parametrize("files", [1, 6])
def test_query_equals_plain(spark, scratch, files):
    docs, labels = untidy()
    write(spark, scratch, docs, labels, files)
    assert rows_of(A.op11(spark, scratch)) == plain(docs, labels)


def test_every_file_a_batch(spark, scratch):
    docs, labels = untidy()
    write(spark, scratch, docs, labels, 5)
    counters = A.mask_counters(spark, f"{scratch}/documents.parquet", spark.read.parquet(f"{scratch}/labels.parquet"), batches=5, bucket=7)
    assert rows_of(A.audit(counters)) == plain(docs, labels)


def test_empty_tables(spark, scratch):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    assert A.op11(spark, scratch).collect() == []


def test_retraction_moves_counts():
    import pandas as pd
    row = lambda i, part: {"d0": 1, "d1": 2, "doc_id": i, "part": part, "mask": 1, "named": True, "claims": True, "n": 1}
    held, changes = A.advance(None, pd.DataFrame([row(9, "en")]))
    assert changes.to_dict("records") == [{"doc_id": 9, "named": True, "part": "en", "mask": 1, "delta": 1}]
    held, changes = A.advance(held, pd.DataFrame([row(4, "de")]))
    assert sorted(map(tuple, changes.values.tolist())) == [(4, True, "de", 1, 1), (9, True, "en", 1, -1), (9, True, "en", 17, 1)]
    assert held["doc_id"].tolist() == [4]
    held, changes = A.advance(held, pd.DataFrame([row(6, "fr") | {"mask": 17, "claims": False}]))
    assert changes.values.tolist() == [[6, True, "fr", 17, 1]] and held["doc_id"].tolist() == [4]
