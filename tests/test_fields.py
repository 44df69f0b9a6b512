"""Fields, guesses, payloads and style conditions on small rows: nulls, empty and very long texts, labels of three strengths."""

from pyspark.sql import functions as F

from quillspark.functions import dates, identifiers, text
from quillspark.operators import enrich, fields
from quillspark.render import conditions


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("v")).first().v


def told(spark, rows):
    df = spark.createDataFrame(rows, "id int, source_type string, text string")
    return {r.id: r.fields for r in fields.source_fields(df).collect()}


def test_labels_of_three_strengths(spark):
    get = lambda t, *names: one(spark, t, lambda c: text.labelled(c, *names))
    assert get("x\n Editor: Ann Lee \n", "editor") == "Ann Lee"
    assert get("Editor: Ann Lee", "editor") == "Ann Lee" and get("the editor - Bo", "editor") == "Bo" and get("our editor Cy Ho", "editor") == "Cy Ho"
    assert get("nothing here\neditor is\nEditor: A", "editor") == "is"  # the first line that holds a label decides
    assert get("Editor:\n", "editor") is None and get("", "editor") is None and get(None, "editor") is None
    assert get("no.: 7", "act no", "no.") == "7"
    assert get("City: Oslo, Place: Rome", "place", "city") == "Rome"  # on one line the label that is named first


def test_fields_of_types_and_odd_rows(spark):
    case = "Smith v. Jones\nCourt: High Court\n[2019] EWCA 12\nDocket: A/7"
    patent = "A Useful Machine for Cutting\nInventor: Ann Lee\nAuthor: Bo Ek\nPatent number: US123\nFiled: 2001-02-03"
    soft = "Quick Sorting Tool\nversion 2.1.0\nLicense: MIT\nDeveloper: Ann"
    long = "Journal: Annals of Long Texts\n" + "word " * 200_000 + "\nVol. 7"
    got = told(spark, [(1, "legal-case", case), (2, "patent", patent), (3, "software", soft), (4, "article-journal", long), (5, "book", None), (6, "no such type", ""), (7, None, "Published: 2020")])
    assert (got[1]["caseName"], got[1]["court"], got[1]["docketNumber"], got[1]["reporter"]) == ("Smith v. Jones", "High Court", "A/7", "[2019] EWCA 12")
    assert (got[2]["inventorOrAssignee"], got[2]["author"], got[2]["patentNumber"], got[2]["filingDate"]) == ("Ann Lee", "Bo Ek", "US123", "2001-02-03")
    assert (got[3]["version"], got[3]["license"], got[3]["title"]) == ("2.1.0", "MIT", "Quick Sorting Tool") and got[3]["authorOrOrganization"]
    assert got[4]["journalTitle"] == "Annals of Long Texts" and got[4]["volume"] == "7"
    assert got[5] == {} and got[6] == {} and got[7]["publicationDate"] == "2020" and got[7]["year"] == "2020"


def test_fields_of_conference_and_chapter(spark):
    paper = "Fast Joins on Slow Machines\nWe met. Proceedings of the 5th Congress on Data, Oslo. pp. 3–9"
    got = told(spark, [(1, "paper-conference", paper), (2, "chapter", "On Bees\nIn: The Book of Insects. Oslo, 3rd edition")])
    assert got[1]["conferenceTitle"] == "5th Congress on Data, Oslo" and got[1]["pages"] == "3-9" and got[1]["proceedingsTitle"] == "of the 5th Congress on Data, Oslo. pp. 3-9"
    assert got[2]["bookTitle"] == "The Book of Insects" and got[2]["edition"] == "3rd edition"


def test_given_values_win_and_empty_ones_do_not(spark):
    df = spark.createDataFrame([("Author: Bo Ek\nA title long enough to be one",)], "text string").withColumn("source_type", F.lit("report"))
    out = fields.source_fields(df, given=F.create_map(F.lit("author"), F.lit("Ann"), F.lit("title"), F.lit(" "), F.lit("doi"), F.lit(None).cast("string"))).first().fields
    assert out["author"] == out["authorOrOrganization"] == "Ann" and out["title"] == "A title long enough to be one" and "doi" not in out


def test_abstracts(spark):
    get = lambda t: one(spark, t, lambda c: fields.abstract(fields.lines_of(c)))
    assert get("Title\nAbstract - We show\nthat it works.\nKeywords: a") == "We show that it works."
    assert get("on. Abstract: " + "x" * 50 + " introduction") == "x" * 50 and get("no such part") is None
    assert get("Abstract\n" + "\n".join(f"l{i}" for i in range(20))) == " ".join(f"l{i}" for i in range(11))


def test_front_dates_and_selections(spark):
    day = lambda t: (lambda r: r and r.date_parts)(one(spark, t, dates.front_date))
    assert day("Received 3 Sept. 2019") == [[2019, 9, 3]] and day("May 7, 2001 and 2 Feb 1999") == [[1999, 2, 2]]
    assert day("31 Feb 2001, March 4 2002") == [[2002, 3, 4]] and day("2001-13-01") is None and day(None) is None
    target = lambda t: one(spark, t, identifiers.selection_target)
    assert (target("see (doi:10.1000/a.b)."), target("ISBN 978-0306406157"), target("PMID: 123456"), target(" a title ")) == ("10.1000/a.b", "978-0306406157", "PMID:123456", "a title")


def test_payloads_without_content(spark):
    for made in (enrich.from_open_library, enrich.from_google_books, enrich.from_semantic_scholar, enrich.from_citoid):
        for payload in ("{}", "", None, "[]", "no json"):
            got = one(spark, payload, lambda c: made(c, F.lit("1")))  # noqa: B023
            assert got is None or (made is enrich.from_citoid and payload in ("{}", "no json"))


def test_style_sort_keys_and_conditions(spark):
    xml = '<style class="note" default-locale="de-AT"><info><title>T &amp; U</title><id>i</id></info><bibliography><sort><key macro="a" sort="descending"/><key variable="issued"/></sort></bibliography></style>'
    info, keys = one(spark, xml, conditions.style_info), one(spark, xml, conditions.sort_keys)
    assert (info.title, info.id, info["class"], info.default_locale, info.has_citation) == ("T & U", "i", "note", "de-AT", False)
    assert [(k.variable, k.macro, k.ascending) for k in keys] == [(None, "a", False), ("issued", None, True)]
    df = spark.createDataFrame([("book", "12-3", None), (None, "x", "p")], "type string, page string, publisher string")
    c = conditions
    got = df.select(c.choose("all", c.has_type("book"), c.is_numeric("page")).alias("a"), c.choose("none", c.has_variable("publisher")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]
