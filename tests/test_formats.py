"""Readers and writers: small files of our own, and the law that parsing a written record gives it back."""

from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import extract
from quillspark.plans.library import records
from quillspark.sinks import write
from quillspark.sources import parse

BIB = r"""@comment{x}
% @article{hidden, title={no}}
@string{j = "J"}
@article{smith, title = {A {Great} Study}, author = {Smith, John and {Some Group}}, year = 2020, month = mar, journal = "J. of " # {Things}, volume=12, pages={10--20}, doi={10.1000/xyz}}
@book(knuth, title={The Art}, author="Donald E. Knuth", date={1997-05-02})
"""


def parsed(spark, parser, content):
    return parser(spark.createDataFrame([(content,)], "content string")).orderBy("_seq").collect()


def test_bibtex(spark):
    a, b = parsed(spark, parse.bibtex, BIB)
    assert (a.id, a.type, a.title, a.container_title, a.page, a.issued.date_parts) == ("smith", "article-journal", "A Great Study", "J. of Things", "10–20", [[2020, 3]])
    assert [(n.family, n.given, n.literal) for n in a.author] == [("Smith", "John", None), (None, None, "Some Group")]
    assert (b.type, b.author[0].family, b.issued.date_parts) == ("book", "Knuth", [[1997, 5, 2]])


def test_bibtex_unclosed_entry_is_reported(spark):
    (a,) = parsed(spark, parse.bibtex, "@article{x, title={T}, year=2020")
    assert a.title == "T" and a._errors


def test_ris(spark):
    a, b = parsed(spark, parse.ris, "TY  - JOUR\nAU  - Doe, Jo\nTI  - One\n  more\nPY  - 2021/03\nSP  - 1\nEP  - 9\nSN  - 1234-5678\nKW  - a\nKW  - b\nER  - \nTY  - BOOK\nTI  - Two\nSN  - 9780306406157")
    assert (a.title, a.page, a.ISSN, a.keyword, a.issued.date_parts) == ("One more", "1–9", "1234-5678", "a, b", [[2021, 3]])
    assert (b.type, b.ISBN, b.id) == ("book", "9780306406157", "ris-2")


def test_medline_and_endnote_and_json(spark):
    (m,) = parsed(spark, parse.medline, "PMID- 12\nTI  - A\n      b\nAU  - Roe JA\nDP  - 2024 Mar\nAID - 10.1/x [doi]\n")
    assert (m.title, m.DOI, m.author[0].given, m.issued.date_parts) == ("A b", "10.1/x", "J. A.", [[2024, 3]])
    (e,) = parsed(spark, parse.endnote, "<xml><records><record><ref-type name='x'>5</ref-type><author><style>Doe, J</style></author><title><style>A &amp; B</style></title><year>2001</year></record></records></xml>")
    assert (e.type, e.title, e.author[0].family) == ("chapter", "A & B", "Doe")
    a, b = parsed(spark, parse.csl_json, '[{"id":"a","type":"legal_case","volume":3},{"id":"b","type":"nope"}]')
    assert (a.type, a.volume, a._errors) == ("legal-case", "3", []) and b._errors


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Author,Year,Journal,Type\n"A, b","Doe, Jo; Ann Lee",2020,J,Article\n,x,1,,\n')
    (r,) = parse.read(spark, str(tmp_path / "a.csv"), "csv").collect()
    assert (r.title, r.type, r.issued.date_parts, [n.family for n in r.author]) == ("A, b", "article-journal", [[2020]], ["Doe", "Lee"])


def test_large_files_are_cut_while_scanned(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    assert {r.id for r in parse.read(spark, str(tmp_path / "a.bib"), "bibtex", large=True).collect()} == {"smith", "knuth"}
    assert {r.id for r in parse.read(spark, str(tmp_path / "a.bib")).collect()} == {"smith", "knuth"}


def test_empty_and_odd_contents(spark):
    df = spark.createDataFrame([(None,), ("",), ("@",), ("TY  - ",), ("{",), ("<record>",)], "content string")
    for parser in parse.PARSERS.values():
        parser(df).collect()


def test_export_round_trip(spark, sf, tmp_path):
    r = records(spark, sf).where("_seq between 1 and 8 AND author IS NOT NULL")
    write.export(r, "ris", str(tmp_path / "out"))
    back = parse.read(spark, str(tmp_path / "out"), "ris")
    assert {(x.title, x.DOI) for x in back.collect()} == {(x.title, x.DOI) for x in r.collect()}


def test_written_forms(spark):
    df = parse.conform(parse.bibtex(spark.createDataFrame([(BIB,)], "content string"))).where("id = 'smith'")
    made = {f: df.select(write.entry(df, f)).first()[0] for f in ("word", "yaml", "csljson", "csv", "markdown", "text")}
    assert "<b:Last>Smith</b:Last>" in made["word"] and 'issued: "2020-3"' in made["yaml"] and '"container-title":"J. of Things"' in made["csljson"]
    assert made["csv"].startswith('article-journal,A Great Study,"Smith, John; Some Group",2020') and "*J. of Things*" in made["markdown"] and "<i>" not in made["text"]


def test_json_ld_wins_over_meta_tags(spark):
    html = '<html lang="en"><script type="application/ld+json">{"@type":"NewsArticle","headline":"H","author":{"name":"Jo Roe"},"datePublished":"2020-01-02"}</script><meta name="citation_title" content="M"></html>'
    r = extract.pages(spark.createDataFrame([(1, html, "https://example.org")], "page_id int, html string, url string")).first()
    assert (r.type, r.title, r.author[0].family, r.issued.date_parts) == ("article-newspaper", "H", "Roe", [[2020, 1, 2]])


def test_pdf_information(spark):
    raw = bytearray(b"%PDF-1.4 /Title (A \\(b\\)) /CreationDate (D:20200304) doi:10.1000/xyz ")
    r = spark.createDataFrame([(raw,)], "c binary").select(extract.pdf_info(F.col("c")).alias("p"), dates.year_of(extract.pdf_info(F.col("c"))["issued"]).alias("y")).first()
    assert (r.p.title, r.p.DOI, r.y) == ("A (b)", "10.1000/xyz", 2020)


def test_an_at_sign_in_a_value_opens_no_entry(spark):
    (a,) = parsed(spark, parse.bibtex, "@misc{x, note={write to me@site (Lund) or @home{now} soon}, year=2020}")
    assert a.id == "x" and a.issued.date_parts == [[2020]] and a._errors == []
    a, b = parsed(spark, parse.bibtex, "@misc{x, title={open}, year=2020\n@misc{y, title={Two}}")
    assert (a.title, b.title) == ("open", "Two") and a._errors and not b._errors


def test_mixed_contents_lose_nothing(spark):
    contents = ["a,Title,c\n1,\"A, \"\"b\"\"\n c\",2\n", "Title\tYear\tx\nT\t2020\t\n", "TY  - JOUR\nTI  - R\nER  - \n", None, "a,b,c\n1,2,3\n"]
    got = parse.parse_any(spark.createDataFrame(list(enumerate(contents)), "n int, content string")).orderBy("n").collect()
    assert [(r.n, r.title) for r in got] == [(0, 'A, "b"\n c'), (1, "T"), (2, "R"), (3, None), (4, None)]
    assert got[3]._errors and got[4]._errors == ["no known column"] and not got[0]._errors


def test_exported_files_are_whole(spark, sf, tmp_path):
    import json

    r = records(spark, sf).limit(30).repartition(3)
    for fmt in ("csv", "csljson", "word", "yaml"):
        write.export(r, fmt, str(tmp_path / fmt))
    texts = lambda fmt: [p.read_text() for p in sorted((tmp_path / fmt).glob("part-*"))]
    back = parse.read_csv(spark, str(tmp_path / "csv"))
    assert {x.title for x in back.collect()} == {x.title.strip() for x in r.collect() if x.title.strip()}
    assert sum(len(json.loads(t)) for t in texts("csljson")) == 30
    assert all(t.startswith("<?xml") and t.rstrip().endswith("</b:Sources>") for t in texts("word"))
    assert all("references:" in t for t in texts("yaml"))


def test_backup_and_restore(spark, sf, tmp_path):
    from quillspark.operators import library

    r = records(spark, sf)
    library.backup({"records": r}, str(tmp_path / "b"))
    back = library.restore(spark, str(tmp_path / "b"), {"records": r})["records"]
    assert sorted(back.collect(), key=lambda x: x._seq) == sorted(r.collect(), key=lambda x: x._seq)


def test_host_types(spark):
    urls = ["https://www.nature.com/articles/x", "https://www.amazon.com/dp/1", "https://www.nytimes.com/a", "https://arxiv.org/abs/1", "https://example.org/z"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(extract.host_type(F.col("u"))).collect()
    assert [x[0] for x in got] == ["article-journal", "book", "article-newspaper", "article", None]
