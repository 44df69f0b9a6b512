"""Near-duplicate vectors, the filter audit and periodic runs against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest

from quillspark.llm import interaction_audit, itq_dedup, periodic_runs

rng = np.random.default_rng(17)


def rows_of(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())


def near_vectors(n, dim, noise):
    base = rng.normal(size=(n // 4, dim))
    return np.concatenate([base, *(base + noise * rng.normal(size=base.shape) * rng.uniform(0.1, 1.2) for _ in range(3))])


def dedup(spark, rows, kind="float"):
    return itq_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, key string, node long")).toPandas()


@pytest.mark.parametrize(("dim", "noise", "kind"), [(32, 0.2, "float"), (32, 0.2, "double"), (3, 0.05, "double"), (96, 0.15, "float")])
def test_near_vectors_equal_brute_force(spark, dim, noise, kind):
    x = near_vectors(240, dim, noise).astype(np.float32 if kind == "float" else np.float64)
    x[7], x[9] = x[8], 2 * x[8]
    rows = [(1000 - i, v.tolist(), int(i % 60 % 3), "k", 1) for i, v in enumerate(x)]
    rows += [(5, None, 1, "k", 1), (6, [0.0] * dim, 1, "k", 1), (7, [float("nan")] * dim, 1, "k", 1), (8, [1.0], 1, "k", 1), (9, rows[0][1], None, "k", 1), (10, [None] * dim, 1, "k", 1), (11, [float("inf")] * dim, 1, "k", 1)]
    df = pd.DataFrame(rows, columns=["vec_id", "embedding", "label", "key", "node"])
    df["label"] = df.label.astype(object).where(df.label.notna(), None)
    want = itq_dedup.brute_force(df)
    assert want.n_links.sum() > 100
    assert rows_of(dedup(spark, rows, kind), list(want.columns)) == rows_of(want, list(want.columns))


def test_large_groups_are_dealt_over_tiles(spark, monkeypatch):
    for name, value in (("BUCKET", 30), ("FAMILY", 25), ("PAIRS", 200), ("HOLD", 100), ("MANY", 4)):
        monkeypatch.setattr(itq_dedup, name, value)
    x = np.concatenate([rng.normal(size=16) + 0.06 * rng.normal(size=(150, 16)), near_vectors(80, 16, 0.2)])
    rows = [(i, v.tolist(), 1, "k", 1) for i, v in enumerate(x)] + [(500 + i, x[3].tolist(), 1, "k", 1) for i in range(9)]
    want = itq_dedup.brute_force(pd.DataFrame(rows, columns=["vec_id", "embedding", "label", "key", "node"]))
    assert rows_of(dedup(spark, rows, "double"), list(want.columns)) == rows_of(want, list(want.columns))


def test_vectors_of_odd_tables(spark):
    assert len(dedup(spark, [])) == 0
    got = dedup(spark, [(3, None, 1, "k", 1), (3, [1.0, 0.0], None, "k", 1)])
    assert got.values.tolist() == [[3, 0, 3, True]] * 2
    same = dedup(spark, [(4, [1.0, 2.0], 1, "k", 1), (4, [1.0, 2.0], 1, "k", 1), (2, [1.0, 2.0], 1, "k", 1), (None, [1.0, 2.0], 1, "k", 1)])
    assert rows_of(same, ["vec_id", "n_links", "component_id", "kept"])[:2] == [("2.0", "2", "2.0", "True"), ("4.0", "2", "2.0", "False")]


@pytest.mark.parametrize("blocks", [2, 4, 8, 16])
def test_tables_miss_no_link(blocks):
    for x in (near_vectors(400, 32, 0.2), near_vectors(400, 32, 0.02) * 0.05 + rng.normal(size=32)):
        x = itq_dedup.directions(x)
        codes = itq_dedup.Codes(x, 0.98)
        codes.split(blocks)
        at = codes.coordinates(x)
        keys, sketch = codes.keys(at), codes.sketches(at)
        row, block, mask = codes.flips(at)
        own, looks = [set(k) for k in keys.tolist()], [set() for _ in x]
        for r, k in zip(row.tolist(), (keys[row, block] ^ mask).tolist(), strict=True):
            looks[r].add(k)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        assert len(a) and itq_dedup.may_be_near(sketch[a], sketch[b]).all()
        assert all(looks[i] & own[j] or looks[j] & own[i] or own[i] & own[j] for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_forest_joins_what_pairs_join():
    def parts(pairs):
        root = list(range(20))
        for i, j in pairs.tolist():
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        return root

    for _ in range(100):
        pairs = rng.integers(0, 20, (rng.integers(0, 40), 2))
        tree = pairs[itq_dedup.forest(pairs[:, 0], pairs[:, 1])]
        assert parts(tree) == parts(pairs) and len(tree) == 20 - len(set(parts(pairs)))


def brute_audit(docs, labels):
    texts = [t or "" for _, t, _ in docs]
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    failed = []
    for (d, _, source), t in zip(docs, texts, strict=True):
        w = t.encode().split()
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        f += "E" * (d is not None and any(u == t and e is not None and e < d for (e, _, _), u in zip(docs, texts, strict=True)))
        failed.append((source or "", d, f))
    out = []
    for part in {p for p, _, _ in failed}:
        shares = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(d, f) for p, d, f in failed if p == part]
            for k, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                before = sum(p == part and c in f for p, _, f in failed) - len(gone)
                left = [(d, f) for d, f in left if c not in f]
                shares[c] += len(gone)
                rows.append([part, order, k, len(left), len(gone), before, sum(p == part and f == c for p, _, f in failed), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), c])
        out += [[*r[:-1], shares[r[-1]]] for r in rows]
    return out


def test_audit_equals_every_document_through_every_order(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(None, None, None), (None, "", "s"), (1, "x", "s"), (1, "x", "t"), (2, "x", "s"), (3, "A B C", "s"), (4, "é " * 60, None), (5, "a|b", "t"), (6, None, "t"), (7, "", "s")]
    docs += [(10 + i, " ".join(rng.choice(words, rng.integers(1, 120))) + ("" if i % 3 else " $ ABC"), str(i % 3)) for i in range(30)]
    docs += [(100 + i, docs[12 + i % 4][1], str(i % 2)) for i in range(12)] + [(200, "long " * 40_000, "s")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(1, 60, 2)] + [(13, 0, 0), (None, 1, 1), (2, None, 1)]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, source string, part string, mask int")
    flags = spark.createDataFrame([(d, q, None if x is None else int(x)) for d, q, x in labels], "doc_id long, quality int, toxic int")
    got = interaction_audit.audit(df, flags)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(list, got.collect())) == sorted(brute_audit(docs, labels))
    assert interaction_audit.audit(df.where("false"), flags).collect() == []
    assert {r.good_lost for r in interaction_audit.audit(df, flags.where("false")).collect()} == {0}


def odd_texts():
    out = [None, "", " \t\n", "a " * 23, "a " * 24, "a " * 500, "x y z " * 40 + "end", "é\x1cb " * 30 + "w"]
    for _ in range(300):
        w = rng.integers(0, rng.choice([1, 2, 3, 40]), rng.integers(1, 200)).tolist()
        for _ in range(rng.integers(0, 4)):
            a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 25))
            for i in range(a + p, int(rng.integers(a, len(w) + 1))):
                w[i] = w[i - p]
        out.append(" ".join(map(str, w)))
    return out


def test_runs_equal_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    for i, t in enumerate(texts):
        tokens = (t or "").encode().split()
        runs = periodic_runs.brute_runs(tokens)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].runs] == runs and got[i].n_words == len(tokens)
        assert got[i].collapsed.encode() == b" ".join(w for k, w in enumerate(tokens) if k not in dropped)


def test_runs_query_equals_brute_force(spark, tmp_path):
    texts = odd_texts()
    df = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    spark.createDataFrame(df, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = periodic_runs.brute_force(df)
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).toPandas().astype(want.dtypes.to_dict())
    assert (want.n_runs > 0).sum() > 50 and rows_of(got, list(want.columns)) == rows_of(want, list(want.columns))


def test_runs_of_odd_tables(spark):
    schema = "doc_id long, text string"
    long = " ".join(map(str, rng.integers(0, 9, 700).tolist() * 300))
    got = periodic_runs.periodic_runs(spark.createDataFrame([(None, "a " * 30), (1, "a " * 30), (1, "a " * 30), (2, long)], schema)).collect()
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs]) for r in got) == [(0, [(0, 30, 1)]), (1, [(0, 30, 1)]), (1, [(0, 30, 1)]), (2, [(0, 210_000, 700)])]
    assert periodic_runs.periodic_runs(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(1, [(0, 30, 10), (40, 24, 8), (90, 60, 20)]), (2, [])], "id long, runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] for r in rows.orderBy("id").select(periodic_runs.longest_for_period(rows.runs)).collect()] == [(0, 30, 10), None]


def test_ordered_ends_keep_their_neighbours(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    places = rng.permutation(300).tolist()
    ends, held = periodic_runs.Ends(places[0]), {places[0]}
    for p in places[1:]:
        want = max((x for x in held if x < p), default=-1), min((x for x in held if x > p), default=-1)
        assert ends.add(p) == want
        held.add(p)
    assert list(ends) == sorted(places)
