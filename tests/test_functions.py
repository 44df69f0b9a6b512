"""Table-driven tests of scalar functions: one Spark job per function, all its cases at once."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, identifiers, names, text


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


CASES = [
    (text.initials, {"John Andrew": "J. A.", "Jean-Paul": "J.-P.", "J. R. R.": "J. R. R.", "": ""}),
    (text.initials_plain, {"John Andrew": "J. A.", "Jean-Paul": "J.", "D.E.": "D. E."}),
    (text.title_case, {"the art OF war": "The Art of War", "a tale": "A Tale"}),
    (text.title_key, {"The  Art, of: C++ (2nd)": "theartofc2nd"}),
    (lambda c: text.roman(c.cast("int")), {"1": "i", "4": "iv", "1994": "mcmxciv", "0": "0"}),
    (text.clean_latex, {r"Erd\'{o}s --- x": "Erdós –- x", r"\textit{a}~b": "{a}\u00a0b"}),
    (text.strip_braces, {"{A {B}}": "A B"}),
    (text.dash_pages, {"1--2": "1–2", "1-2": "1–2"}),
    (text.unescape_html, {"<i>a &amp; b</i>": "a & b"}),
    (text.style_family, {"apa-6th": "apa", "the-lancet": "vancouver", "turabian-x": "chicago", "zzz": "apa"}),
    (text.pdf_string, {"(a\\(b\\))": "a(b)", "<FEFF00410042>": "AB", "<4142>": "AB"}),
    (identifiers.clean_doi, {"10.1000/a?x=1": "10.1000/a", "10.1000/a).": "10.1000/a", "10.1000/a//": "10.1000/a", "10.1000/a#f": "10.1000/a"}),
    (identifiers.normalise_doi, {"https://doi.org/10.1000/a": "10.1000/a", "doi: 10.1000/a": "10.1000/a", "x": None}),
    (lambda c: identifiers.identify(c)["type"], {"10.1000/a": "DOI", "arXiv:2301.12345": "arXiv", "PMID: 1234567": "PMID", "PMC1234567": "PMC", "978-0-306-40615-7": "ISBN", "none": None}),
    (identifiers.route, {"doi:10.1000/a": "doi", "9780306406157": "isbn", "12345678": "pmid", "2301.12345": "arxiv", "https://x.org": "url", "A title": "title"}),
    (lambda c: identifiers.all_dois(c).cast("string"), {"10.1000/a, 10.1000/a. 10.2000/b-\nc": "[10.1000/a, 10.2000/b-c]"}),
    (lambda c: dates.form_text(dates.fuzzy_date(c)), {"Jan 15, 2023": "2023", "January 15, 2023": "2023-01-15", "soon": "soon"}),
    (lambda c: dates.form_text(dates.page_date(c)), {"2020-05-06T01:00": "2020-05-06", "2020": "2020", "May 4, 2021": "2021-05-04", "Tue, 04 May 2021 10:00:00 GMT": "2021-05-04", "later": "later"}),
    (lambda c: dates.form_text(dates.medline_date(c)), {"2024 Mar 15": "2024-03-15", "2024 Mar": "2024-03", "2024": "2024"}),
    (lambda c: dates.form_text(dates.pdf_date(c)), {"D:20200304120000": "2020-03-04"}),
    (lambda c: dates.check_date(c, 2026), {"2020-13": "invalid_month", "2020-01-40": "invalid_day", "nd": "no_date", "x": "invalid_year", "2050": "future_year", "2020-02-03": None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    make, table = CASES[case]
    assert values(spark, table, make) == list(table.values())


def short(n):
    return {k: v for k, v in n.asDict().items() if v is not None}


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (names.bibtex_name, "van der Berg, Jan", {"family": "van der Berg", "given": "Jan"}),
        (names.bibtex_name, "Ludwig van Beethoven", {"family": "Beethoven", "given": "Ludwig", "non_dropping_particle": "van"}),
        (names.bibtex_name, "King, Jr., Martin", {"family": "King", "given": "Martin", "suffix": "Jr."}),
        (names.bibtex_name, "{World Health Organization}", {"literal": "World Health Organization"}),
        (names.ris_name, "Doe, Jo, III", {"family": "Doe", "given": "Jo", "suffix": "III"}),
        (names.ris_name, "The Group", {"literal": "The Group"}),
        (names.endnote_name, "Ann B. Lee", {"family": "Lee", "given": "Ann B."}),
        (names.medline_name, "Smith JA", {"family": "Smith", "given": "J. A."}),
        (names.byline_name, "By Jane Roe (Editor)", {"family": "Roe", "given": "Jane"}),
    ],
)
def test_name(spark, make, given, want):
    assert short(values(spark, [given], make)[0]) == want


def test_join_parts_drops_a_doubled_sign(spark):
    made = spark.range(1).select(text.join_parts(F.array(F.lit("A."), F.lit(""), F.lit("B")), ". ").alias("x"), text.affix(F.lit("A."), "", ".").alias("y")).first()
    assert (made.x, made.y) == ("A. B", "A.")


def test_inverted_abstract(spark):
    made = spark.range(1).select(text.inverted_abstract(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("x")).first()
    assert made.x == "a b a b"


def test_places_of_words_need_no_shuffle(spark):
    df = spark.createDataFrame([("b a  b c a",), ("",), ("x",), (None,)], "t string")
    out = df.select("t", text.places_of_words(F.split("t", " ")).alias("m"))
    got = [(r.t, r.m) for r in out.collect()]
    assert got == [("b a  b c a", {"a": [1, 5], "": [2], "b": [0, 3], "c": [4]}), ("", {"": [0]}), ("x", {"x": [0]}), (None, None)]
    assert [r[0] for r in out.select(text.inverted_abstract(F.col("m"))).collect()] == ["b a  b c a", "", "x", None]
    from quillspark.plans import registry

    assert "Exchange" not in registry.QUERIES["prj9_inverted_abstract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_page_dates_are_parsed_once(spark):
    rows = ["March 5, 2024", "Mar 5, 2024", "5 March 2024", "5 Mar 2024", "March 2024", "mar 2024", "3/5/2024", "Tuesday, March 5, 2024 10:30", "2024-03", "2024", "May 1, 2020", "Smarch 5, 2024", "31 June 2024", "", None]
    made = dates.page_date(F.col("c"))
    df = spark.createDataFrame([(r,) for r in rows], "c string").select(made.alias("d"))
    got = [None if r.d is None else (r.d.date_parts[0] if r.d.date_parts else r.d.literal) for r in df.collect()]
    assert got == [[2024, 3, 5]] * 4 + [[2024, 3, 1]] * 2 + [[2024, 3, 5]] * 2 + [[2024, 3], [2024], [2020, 5, 1], "Smarch 5, 2024", "31 June 2024", "", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") == len(dates.FORMATS)


def test_fuzzy_dates_look_for_each_part_once(spark):
    df = spark.createDataFrame([("received on 5 March 2024",), ("May 1999",), ("42 June 1850",), ("2001, 7",), ("no year 12",), ("",), (None,)], "c string").select(dates.fuzzy_date(F.col("c")).alias("d"))
    got = [None if r.d is None else (r.d.date_parts[0] if r.d.date_parts else r.d.literal) for r in df.collect()]
    assert got == [[2024, 3, 5], [1999, 5], [1850, 6], [2001], "no year 12", "", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 6
