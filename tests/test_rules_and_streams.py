"""Rendering rules that differ by row, XMP packets of files, retried batches of a stream, case of long texts."""

from pyspark.sql import functions as F

from quillspark.functions import dates, names, text
from quillspark.operators import classify, extract
from quillspark.render import rules
from quillspark.sources import parse
from quillspark.streaming import ingest


def test_rules_of_names(spark):
    people = ["Lee, Ann B.", "Roe, Jo", "Kim, Li-Wei", "Fox, Al"]
    cases = [
        (4, None, '["a"]', None), (3, '{"min":3,"use_first":1}', None, "Ann B. Lee, et al."), (4, '{"min":3,"use_first":2,"use_last":true}', None, "Ann B. Lee, Jo Roe, … Al Fox"), (3, '{"min":3,"use_first":2,"use_last":true}', None, "Ann B. Lee, Jo Roe, et al."),
        (3, '{"conjunction":"and","sort_order":"first"}', None, "Lee, Ann B., Jo Roe, and Li-Wei Kim"), (2, '{"conjunction":"&","delimiter":"; ","initialize_with":".","sort_order":"all"}', None, "Lee, A. B. & Roe, J."), (1, '{"conjunction":"&"}', None, "Ann B. Lee"), (0, '{"min":1}', None, None), (2, "{}", None, "Ann B. Lee, Jo Roe"),
        (1, '{"min":1,"use_first":5,"et_al":"u. a."}', None, "Ann B. Lee, u. a."), (3, '{"initialize_with":".","min":9}', None, "A. B. Lee, J. Roe, L.-W. Kim"),
    ][1:]
    df = spark.createDataFrame([(i, people[:n], r) for i, (n, r, _, _) in enumerate(cases)], "i int, p array<string>, r string")
    got = df.select("i", rules.names_by_rule(F.transform("p", names.byline_name), F.from_json("r", rules.NAME_RULE)).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [w for *_, w in cases]


def test_rules_of_dates_and_numbers(spark):
    rows = [
        ("2020-03-04", '{"form":"numeric"}', "2020-03-04"), ("2020-03", '{"form":"numeric"}', "2020-03"), ("2020-03-04", '{"form":"text"}', "March 4 2020"), ("2020", "{}", "2020"), ("soon", '{"parts":[{"name":"year"}]}', "soon"), (None, "{}", None),
        ("2020-03-04", '{"delimiter":" ","parts":[{"name":"day","form":"ordinal"},{"name":"month","form":"short"},{"name":"year","prefix":"(","suffix":")"}]}', "4th Mar. (2020)"), ("2020", '{"parts":[{"name":"month"}]}', ""), ("2020-3-4", '{"parts":[{"name":"month","form":"numeric-leading-zeros"},{"name":"day","form":"numeric-leading-zeros"}]}', "0304"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, r string, w string")
    got = df.select("i", "w", rules.date_by_rule(dates.form_date(F.col("d")), F.from_json("r", rules.DATE_RULE)).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [r.w for r in got]
    n = spark.createDataFrame([("4", "ordinal", "4th"), ("4", "roman", "iv"), ("4", "long-ordinal", "4"), ("4a", "roman", "4a"), (None, "roman", None), ("4", None, "4"), ("0", "roman", "0")], "v string, f string, w string")
    assert all(r.s == r.w for r in n.select("w", rules.number_by_form(F.col("v"), F.col("f")).alias("s")).collect())


def test_xmp_of_binary_files(spark, tmp_path):
    packet = "<x:xmpmeta><rdf:RDF><dc:title><rdf:Alt><rdf:li xml:lang='x'>Title &amp; é</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>A B</rdf:li></rdf:Seq></dc:creator><prism:startingPage>5</prism:startingPage><prism:coverDate>2001-02</prism:coverDate><pdfx:doi>10.5/x</pdfx:doi></rdf:RDF></x:xmpmeta>"
    (tmp_path / "a.pdf").write_bytes(b"%PDF\xff\xfe" + packet.encode() + b"\x00\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF /Title (Own) 10.1234/own. \xff " + packet.replace("10.5/x", "10.9999/other").encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.pdf").write_bytes(b"</x:xmpmeta> <x:xmpmeta> open")
    got = {r.path[-5:-4]: r.info for r in extract.pdf_files(spark, str(tmp_path)).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.title, a.author, a.page, a.DOI, a.issued.date_parts) == ("Title & é", "Title & é; A B", "5", "10.5/x", [[2001, 2]])
    assert (b.title, b.DOI) == ("Own", "10.1234/own") and c.title is None and c.issued is None and d.title is None


def test_a_retried_batch_comes_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ris").write_text("TY  - JOUR\nTI  - Short\nER  - \nTY  - JOUR\nTI  - Shorter\nER  - \n")
    spark.sql("DROP TABLE IF EXISTS retried_library")

    def go():
        stream = ingest.records(ingest.contents(spark, str(tmp_path / "in"))).select("id", "title", "DOI", "ISBN", "URL", "_seq", "_file")
        ingest.into_library(stream, "retried_library", str(tmp_path / "ck")).awaitTermination()
        spark.catalog.refreshTable("retried_library")
        return spark.table("retried_library")

    try:
        assert go().count() == 2
        (tmp_path / "in" / "b.ris").write_text("TY  - JOUR\nTI  - Third\nER  - \n")
        assert go().count() == 3
        for f in (tmp_path / "ck" / "commits").iterdir():
            if f.name.strip(".").startswith("1"):
                f.unlink()  # as if the driver had been lost between the append and its commit
        assert go().count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS retried_library")


def test_long_words_keep_their_ends(spark):
    df = spark.createDataFrame([("ab" * 750_000,)], "c string")
    for mode in ("capitalize-first", "capitalize-all", "sentence", "title"):
        assert df.select(F.length(text.text_case(F.col("c"), mode))).first()[0] == 1_500_000


def test_deep_braces_are_read_or_reported(spark):
    nest = lambda n: "{" * n + "x" + "}" * n
    bib = f"@article{{a, title = {{T {nest(7)}}}}}\n@book{{b, title={{{nest(39)}}}}}\n@misc{{e, title={{{nest(60)}}}}}\n@misc{{g, title={{last}}}}"
    got = {r.id: r for r in parse.bibtex(spark.createDataFrame([(bib,)], "content string")).collect()}
    assert (got["a"].title, got["b"].title, got["g"].title) == ("T x", "x", "last") and not got["a"]._errors and not got["b"]._errors and got["e"]._errors


def test_patterns_that_are_not_tried_do_not_match(spark):
    words = ["Journal of", "Vol. 3", "no 5", "pp. 3-9", "ISSN 1234-567X", "TV", "2nd ed", "revised edition", "In:", "Eds.", "PhD", "report no. 5", "Act", "v. x", "[2001] ABC 5", "US1234", "GSE12", "OSF", "version 2", "runtime: 90 min", "www.a.b", "12(3): 4-5", "May 5, 2020", "10.1234/ab", "ISBN 978-0-12", "éact", "İN:", "K"]
    df = spark.createDataFrame([(f"{a} {b}",) for a in words for b in words], "t string")
    low, digit = F.lower("t"), F.col("t").rlike("[0-9]")
    missed = [F.count_if(F.col("t").rlike(p) & ~classify.may_match(n, low, digit)) for (_, _, p), n in zip(classify.RULES, classify.NEEDS, strict=True)]
    assert not any(df.select(*(c.alias(f"c{i}") for i, c in enumerate(missed))).first())


def test_words_decide_which_patterns_are_tried(spark):
    words = ["Journal of", "fact", "ACT", "act_2", "act", "\u212aact", "\u0130N:", "In:", "Master's", "masters", "Revised Edition", "no. 5", "GSE12", "WWW.a.b", "https://x", "Eds.", "editing", "geometry", "GEO", "v. x", "May 5, 2020", "version v2", "report nothing", "aired on", "éact", "posted by"]
    texts = [*(f"{a}{s}{b}" for a in words for b in words for s in (" ", "/", "")), "x" * 5000 + " thesis", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    low = classify.lowered(F.col("text"))
    assert df.where(~F.sort_array(classify.words_of(low)).eqNullSafe(F.sort_array(classify.words_of(low, 0)))).count() == 0
    told = F.coalesce("text", F.lit(""))
    hits = F.array(*(F.when(told.rlike(p.replace(r"\b", classify.BORDER)), F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"))) for k, w, p in classify.RULES))
    got = {r.i: r for r in classify.classify(df.withColumn("hits", hits)).collect()}
    for r in got.values():
        sums = {k: sum(h.w for h in r.hits if h and h.k == k) for k in classify.kinds()}
        best = sorted((k for k in sums if sums[k]), key=lambda k: -sums[k])
        assert r.ranked == ",".join(f"{k}:{sums[k]}" for k in best[:5]) and r.source_type == (best[0] if best else "unknown"), r.text
    # Parts of other words let no pattern be tried.
    idle = spark.createDataFrame([("The fact of practice: geometry, posture, bill-boards no, editing visits.",)], "t string").select(F.lower("t").alias("low"))
    tried = [classify.may_match(n, F.col("low"), F.lit(False)) for n in classify.NEEDS]
    assert [i for i, x in enumerate(idle.select(*(c.alias(f"c{i}") for i, c in enumerate(tried))).first()) if x] == [21]  # bill
