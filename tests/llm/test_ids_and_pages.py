"""Long ids beside nulls, and pages of odd makes."""

import pytest

from graphrec.llm import dom, html_main, langid, packing, repetition
from graphrec.llm.queries import vocabulary_path
from test_operators import prose

BIG = 2**53 + 1
IDS = [BIG, None, BIG + 2, 5, -BIG]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(("xa", "xb")[k % 2], 60 + 900 * (k == 3)), ("xa", "xb")[k % 2], "s", i) for k, i in enumerate(IDS * 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, other long").coalesce(1)


def ids(d, column="doc_id"):
    return {r[column] for r in d.collect()}


def test_language_id_keeps_ids(docs):
    assert ids(langid.language_id(docs)) == set(IDS)
    assert ids(langid.confident(docs)) == set(IDS) == ids(langid.confident(docs), "other")


def test_repetition_keeps_ids(docs):
    assert ids(repetition.repetition(docs)) == set(IDS)


def test_packing_keeps_ids(docs):
    pieces = packing.packed_documents(docs, vocabulary_path())
    assert ids(pieces) == set(IDS) and pieces.filter("piece > 0").count() > 0
    ids_of = packing.token_pieces(docs, vocabulary_path(), with_ids=True).select("doc_id", "length", "ids").collect()
    assert {r["doc_id"] for r in ids_of} == set(IDS) and all(len(r["ids"]) == r["length"] for r in ids_of)


def test_main_text_keeps_ids(spark):
    rows = [(i, "http://a.b/", f"<nav>menu</nav><article><p>An article of some words, number {k}.</p></article>") for k, i in enumerate(IDS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = html_main.main_text(pages)
    assert ids(got, "page_id") == set(IDS)


def test_other_columns_pass_whatever_their_type(spark, docs):
    from datetime import date, datetime
    from decimal import Decimal

    kinds = "doc_id string, text string, lang string, at timestamp, day date, cost decimal(20,4), tags array<long>, more map<string,long>, pair struct<a:long,b:string>, flag boolean, raw binary"
    row = ("x1", prose("xa", 80), "xa", datetime(2024, 1, 2, 3), date(2024, 1, 2), Decimal("1.5"), [1, None, BIG], {"k": BIG}, (BIG, None), True, b"\0")
    d = spark.createDataFrame([row, (None, prose("xb", 80), "xb", *[None] * 8)], kinds).coalesce(1)
    assert sorted(map(str, langid.confident(d).collect())) == sorted(map(str, d.collect()))


@pytest.mark.parametrize(("text", "letter"), [("½ ² ①", False), ("Ⅷ Ⅸ", False), ("12 _ !", False), ("", False), ("½ a", True), ("é", True), ("中", True), ("٣", False), ("٣ب", True)])
def test_letters_are_of_the_letter_category(spark, docs, text, letter):
    assert langid.has_letter(text) == letter


def test_numerals_are_no_language(spark, docs):
    model = langid.learn(docs)
    d = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ Ⅸ"), (3, prose("xa", 30))], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "xa"


# --- Pages


def texts(source):
    return [t for _, t, _ in dom.Page(source).blocks]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p data-by=O'Neil>First paragraph.</p><p>Don't lose this paragraph.</p><p>Third.</p>", ["First paragraph.", "Don't lose this paragraph.", "Third."]),
        ('<p class="a"">One.</p><p title="b">Two.</p>', ["One.", "Two."]),
        ("<p 'x>One.</p><p>It's two.</p>", ["One.", "It's two."]),
        ("<p title='a > b' class=c>One.</p>", ["One."]),
        ('<p title = "a > b">One.</p><p a=b"c>Two "words".</p>', ["One.", 'Two "words".']),
        ("<a href=x?y=\"z>link</a> <b>text</b>", ["link text"]),
        ("<p>a</p><!--><p>b</p><!---><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><!-- x --!><p>b</p><!-- <p>no</p> --><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><!-- never closed <p>b</p>", ["a"]),
        ('<p class="never closed>One.</p>', ["One."]),
        ("a < b and c > d <p>One", ["a < b and c > d", "One"]),
        ("<p =>x</p><p a= >y</p><p a=>z</p>", ["x", "y", "z"]),
    ],
)
def test_quotes_and_comments_end_as_in_browsers(source, want):
    assert texts(source) == want


def test_stray_quotes_take_no_long():
    import time

    began = time.time()
    page = dom.Page("<p a=O'Neil b='>x</p>\n" * 20_000 + "<p =\"" * 20_000 + "<i '" * 20_000)
    assert time.time() - began < 20 and len(page.tag) > 1


def small_page(k):
    return f"<html><body><nav><a href=/>Home</a> <a href=/x>About</a></nav><article><h1>Title {k}</h1><p data-by=O'Neil>The first paragraph of number {k}, long enough.</p><p>It's the second one.</p></article><footer>Copyright</footer></body></html>"


@pytest.mark.parametrize("n", [1, 2, 4])
def test_tables_of_few_pages(spark, n):
    pages = spark.createDataFrame([(k, "http://a.b/", small_page(k)) for k in range(n)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.main_text(pages).collect()}
    assert got == {k: f"Title {k}\n\nThe first paragraph of number {k}, long enough.\n\nIt's the second one." for k in range(n)} | {9: ""}


def test_landmarks_alone(spark):
    pages = spark.createDataFrame([(1, "<div>a text without landmarks</div><nav>menu</nav>"), (2, "<div>around</div><main>inside</main>"), (3, "plain")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages, None, keep=()).collect()}
    assert got == {1: "a text without landmarks", 2: "inside", 3: "plain"}
