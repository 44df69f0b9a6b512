"""Title joins, the substring index, stored tables, deep pages and numbers, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import paging, similar, stored, substring_index


def best_by_hand(new, held):
    import re

    words = lambda t: set(re.split(r"\s+", re.sub(r"[^\w\s]", "", t.lower(), flags=re.A)))
    out = {}
    for k, t in new:
        if t is None:
            continue
        scored = [(len(words(t) & words(u)) / max(len(words(t)), len(words(u))), h) for h, u in held if u is not None and h != k]
        fit = [(-s, h) for s, h in scored if s >= 0.6]
        if fit:
            out[k] = (min(fit)[1], round(-min(fit)[0], 9))
    return out


def test_best_titles_equal_all_pairs(spark):
    base = "a study of the growth of plants in cold water and light".split()
    rows = [(f"r{i:03d}", " ".join(w if (i * 7 + j) % 9 else f"x{i % 5}{j}" for j, w in enumerate(base[: 4 + i % 8]))) for i in range(120)]
    rows += [("s1", None), ("s2", ""), ("s3", ""), ("s4", "!!!"), ("s5", "word " * 3000), ("s6", "word"), ("r000", "repeated key")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, title string, words string")
    got = {}
    for r in similar.best_titles(df, df).collect():
        got.setdefault(r.id, set()).add((r.match, round(r.similarity, 9)))
    once = [r for r in rows if r[1] != "repeated key"]
    want = best_by_hand(once, rows)
    assert {k: v for k, v in got.items() if k != "r000"} == {k: {v} for k, v in want.items() if k != "r000"} and len(want) > 60
    assert similar.best_titles(df.where("false"), df).collect() == [] and similar.best_titles(df, df.where("false")).collect() == []


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rows = [("a", "The Cat", "x"), ("b", "concatenate", None), ("c", None, "CATalogue"), ("d", "", ""), (None, "cat", "cat"), ("e", "ca", "t"), ("f", "naïve CÁT 𝔘nicode", "y"), ("g", "cat " * 50_000, None), ("a", "other", "cat")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, title string, note string, gram int")
    substring_index.build(df, "id", ["title", "note"], str(tmp_path / "i"))
    for text in ("cat", "CAT", "ca", "", "the cat", "cát", "𝔘ni", "nothing", "cat cat", "t c"):
        got = sorted(r.title or "" for r in substring_index.search(df, "id", ["title", "note"], str(tmp_path / "i"), text).collect())
        want = sorted(t or "" for k, t, n in rows if (k is not None or len(text) < 3) and any(text.lower() in (x or "").lower() for x in (t, n) if x is not None))
        assert got == want, text


def test_index_reads_only_the_folders_of_its_grams(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("number "), F.sha2(F.col("id").cast("string"), 256)).alias("title"))
    path = str(tmp_path / "i")
    substring_index.build(df, "id", ["title"], path)
    found = substring_index.candidates(spark, path, "number abc")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan
    folders = plan.split("PartitionFilters: [")[1].split("]")[0].split("folder#")[-1].count(",") + 1
    assert folders <= substring_index.READ and found.count() < 300


def library(spark, path):
    return stored.Stored(spark, path, parts=8)


def test_stored_rows_are_replaced_in_their_parts_only(spark, tmp_path):
    path = str(tmp_path / "l")
    lib = library(spark, path)
    assert lib.manifest()["folders"] == {}
    df = spark.createDataFrame([(f"k{i}", i, [i]) for i in range(100)] + [(None, 1, [])], "id string, n int, l array<int>")
    assert lib.upsert(df) == 8 and lib.read().count() == 100
    before = lib.manifest()["folders"]
    old = lib.read()
    assert lib.upsert(spark.createDataFrame([("k5", -5, None), ("new", 1, [2])], df.schema)) <= 2
    after = lib.manifest()["folders"]
    assert 1 <= sum(before[p] != after[p] for p in after) <= 2
    rows = {r.id: r.n for r in lib.read().collect()}
    assert len(rows) == 101 and rows["k5"] == -5 and rows["k6"] == 6
    assert {r.id: r.n for r in old.collect()}["k5"] == 5  # a version once opened stays
    assert lib.update(spark.createDataFrame([("k6",), ("none",)], "id string"), n=F.col("n") * 10) <= 2
    assert lib.delete(spark.createDataFrame([("k7",), ("k7",)], "id string")) == 1
    rows = {r.id: r.n for r in lib.read().collect()}
    assert rows["k6"] == 60 and "k7" not in rows and len(rows) == 100


def test_stored_keys_are_read_from_their_parts(spark, tmp_path):
    lib = library(spark, str(tmp_path / "l"))
    lib.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(400)], "id string, n int"))
    got = lib.get(["k3", "k9", "absent"])
    assert sorted(r.n for r in got.collect()) == [3, 9] and len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= 3


def test_a_broken_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    lib = library(spark, str(tmp_path / "l"))
    lib.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))

    def lost(manifest):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(lib, "_commit", lost)
    with pytest.raises(RuntimeError):
        lib.upsert(spark.createDataFrame([("a", 9)], "id string, n int"))
    assert {(r.id, r.n) for r in library(spark, lib.path).read().collect()} == {("a", 1), ("b", 2)}
    assert json.loads((tmp_path / "l" / "CURRENT").read_text())["folders"]


def test_deleting_all_rows_leaves_an_empty_table(spark, tmp_path):
    lib = library(spark, str(tmp_path / "l"))
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    assert lib.upsert(df) == 1 and lib.delete(df) == 1
    assert lib.read().collect() == [] and lib.read().columns == ["id", "n"] and lib.upsert(df.where("false")) == 0


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit(1).alias("_at"))
    got = paging.numbered(df.select("k").repartition(7), "k").collect()
    assert sorted((r.k, r.row) for r in got) == [(i, i) for i in range(5000)]
    assert [r.k for r in paging.page(df.select("k"), 33, F.col("k").desc()).collect()] == list(range(4999 - 33 * 50, 4999 - 34 * 50, -1))
    assert paging.numbered(df.where("false").select("k"), "k").collect() == []


def test_pages_follow_their_last_row(spark):
    rows = [(i % 4 if i % 5 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    last, got = None, []
    while True:
        page = paging.page_after(df, last, "a", size=7).collect() if last else df.orderBy(F.col("a").desc_nulls_last(), "b").limit(7).collect()
        if not page:
            break
        got += [tuple(r) for r in page]
        last = {"a": page[-1].a, "b": page[-1].b}
    assert got == want


def test_numbers_collapse_and_years_get_letters(spark):
    df = spark.createDataFrame([("x", n) for n in (3, 1, 2, 2, 7, 9, 10)] + [("y", None), ("z", 5)], "cluster string, number long")
    assert {r.cluster: r.cited for r in paging.collapsed(df).collect()} == {"x": "1-3, 7, 9, 10", "z": "5"}
    rows = [(f"i{k:04d}", "Roe, Jo", 2001) for k in range(730)] + [("j", "Roe, Jo", 2002), ("k", "Roe, Jo", None), ("l", None, 2001), ("m", None, 2001)]
    got = {r.id: r.year_suffix for r in paging.year_suffixes(spark.createDataFrame(rows, "id string, names string, year int"), "id").collect()}
    assert [got[f"i{k:04d}"] for k in (0, 25, 26, 701, 702, 729)] == ["a", "z", "aa", "zz", "aaa", "abb"]
    assert (got["j"], got["k"], got["l"], got["m"]) == (None, None, "a", "b")


def test_titles_that_cannot_do_leave_the_join_as_no_rows(spark):
    rows = [(f"s{i}", ["shared", *(f"w{i}x{j}" for j in range(i % 9 + 8))]) for i in range(300)] + [("t1", [f"t{j}" for j in range(10)]), ("t2", [f"t{j}" for j in range(4, 14)]), ("t3", [f"t{j}" for j in range(5, 15)])]
    df = spark.createDataFrame(rows, "set string, words array<string>")
    got = similar.similar_titles(df, df)
    assert {(r.new_set, r.held_set, round(r.similarity, 9)) for r in got.collect() if r.new_set < r.held_set} == {("t1", "t2", 0.6), ("t2", "t3", 0.9)}
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("bit_count" in x for x in joins)
    a, b = F.array(*(F.lit(f"w{i}") for i in range(40))), F.array(*(F.lit(f"w{i}") for i in range(30, 70)))
    bits = spark.range(1).select(similar._sketch(a).alias("a"), similar._sketch(b).alias("b")).first()
    assert 0 < sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits.a, bits.b)) <= 60


def test_pairs_of_titles_carry_numbers_and_meet_once(spark):
    rows = [(f"s{i:03d}", sorted({f"w{(i // 5) * 7 + (j if j % 6 else j + i % 5)}" for j in range(12)})) for i in range(100)]
    df = spark.createDataFrame(rows, "set string, words array<string>")
    fit = {(a, b): len({*x} & {*y}) / max(len(x), len(y)) for a, x in rows for b, y in rows if 10 * len({*x} & {*y}) >= 6 * max(len(x), len(y))}
    for held in (df, df.select("*")):  # one table, and two
        sets, others, pairs = similar.numbered_pairs(df, held)
        query = pairs._jdf.queryExecution()
        assert "words" not in query.executedPlan().toString()
        assert any("Join Inner" in x and "(new_no#" in x and "< held_no#" in x for x in query.optimizedPlan().toString().splitlines()) == (held is df)
        mine, theirs = ({r._no: r.set for r in x.collect()} for x in (sets, others))
        got = [((mine[r.new_no], theirs[r.held_no]), r.similarity) for r in pairs.collect()]
        assert len(got) == len(fit) > 300 and dict(got) == fit


def test_index_is_dealt_over_more_tasks_for_longer_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_index, "LETTERS", 300)
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("the same words "), "id").alias("title"))
    path = str(tmp_path / "i")
    substring_index.build(df, "id", ["title"], path)
    tasks = {f.rsplit("part-", 1)[1].split("-")[0] for f in spark.read.parquet(f"{path}/postings").inputFiles()}
    assert len(tasks) > 4  # the session's number
    assert sorted(r.id for r in substring_index.search(df, "id", ["title"], path, "WORDS 1").collect()) == sorted(str(i) for i in range(100) if str(i).startswith("1"))
