"""Registered queries against their SQL in DuckDB, on the smallest tables; and the streaming ingest."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from quillspark.operators import dedupe
from quillspark.plans import registry
from quillspark.plans.library import RECORDS_SQL
from quillspark.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    rows = lambda df: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["flt2_search", "srt1_author_asc", "agg5_fields_filled", "jn1_find_duplicates", "jn3_duplicate_links", "mut6_leave_project", "fmt1_apa", "fmt6_template", "val1_warnings", "snk2_ris", "src1_bibtex_round_trip", "src6_csv_round_trip", "src22_mixed_formats", "agg4_groups", "mut9_keep_one", "prj7_edited", "ext11_classify", "str7_identify", "src10_identifiers", "src11_sniff", "prj9_inverted_abstract", "snk4_word", "snk5_yaml", "src4a_endnote_types"])
def test_same_as_sql(spark, sf, con, name):
    assert same(registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["prj8_semantic_scholar", "src4_endnote"])
def test_records_without_a_title(spark, sf, tmp_path, name):
    rows = [(1, ""), (2, None), (3, " "), (4, "\nsecond line"), (5, "\xa0"), (6, "\t"), (7, "\u3000 A & <b>\xa0\nc"), (8, '"q" &lt;'), (9, "\ta \r\nb")]
    docs = spark.createDataFrame([(i, t, "en", "src1") for i, t in rows], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    own = duckdb.connect()
    for t in ("documents", "labels"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert same(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), own.sql(registry.ORACLE_SQL[name]).df())


def test_records_do_not_shuffle_texts(spark, sf):
    plan = registry.records(spark, sf).hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert "split(text#" in plan[join:] and "split(" not in plan[:join]


def union_find(rows):
    """Smallest _seq of the records that share keys, directly or through others; rows of id, _seq and keys."""
    parent, holder = {r[1]: r[1] for r in rows}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        for k in enumerate(r[2:]):
            if k[1] is not None and k[1] == k[1]:
                a, b = find(r[1]), find(holder.setdefault(k, r[1]))
                parent[max(a, b)] = min(a, b)
    return {r[0]: find(r[1]) for r in rows}


def test_groups_equal_union_find(spark, sf, con):
    rows = con.sql(f"WITH {RECORDS_SQL}, {registry._K.format(m=15)} SELECT id, _seq, k1, k2, k3 FROM rk").fetchall()
    got = {r.id: r.group for r in registry.QUERIES["agg4_record_groups"](spark, sf).collect()}
    assert got == union_find(rows) and len(set(got.values())) < len(got)


def test_groups_spread_along_chains(spark):
    order = [7, 3, 9, 1, 12, 5, 10, 2, 8, 4, 11, 6]
    rows = []
    for at, seq in enumerate(order):  # each shares one key with the next, by DOI, ISBN and title in turn
        keys = [None, None, None]
        for link in (at - 1, at):
            keys[link % 3] = (f"10.1000/x{link}", f"97800000{10000 + link}", f"a title of its own number {link}")[link % 3]
        rows.append((f"r{seq}", seq, *keys))
    rows += [(f"r{n}", n, "10.1000/copied", None, None) for n in range(100, 400)] + [("alone", 500, None, None, None)]
    got = {r.id: r.group for r in dedupe.groups(spark.createDataFrame(rows, "id string, _seq long, DOI string, ISBN string, title string")).collect()}
    assert got == union_find(rows) and {got[f"r{n}"] for n in order} == {1} and got["r399"] == 100 and got["alone"] == 500


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and all(r.entry for r in rows)


def test_registry_names_match():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_streaming_ingest_appends_new_records_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ris").write_text("TY  - JOUR\nTI  - A first long title\nDO  - 10.1/A\nER  - \nTY  - JOUR\nTI  - Another long title\nER  - \n")
    (tmp_path / "in/b.ris").write_text("TY  - JOUR\nTI  - Same work again\nDO  - 10.1/a\nER  - \n")
    stream = ingest.distinct_records(ingest.records(ingest.contents(spark, str(tmp_path / "in")))).select("id", "title", "DOI", "_seq")
    q = stream.writeStream.format("memory").queryName("ingested").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.table("ingested").count() == 2
