import pytest

from wiretide.llm import language

WORDS = {"en": "the house and the garden with a tree that was there for years", "de": "das haus und der garten mit einem baum der dort seit jahren war",
         "fr": "la maison et le jardin avec un arbre qui était là pendant des années"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join((WORDS[lang].split() * 4)[i % 7:i % 7 + 30]), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    return spark.createDataFrame(rows + [(500, None, "en"), (501, "x", None)], "doc_id long, text string, lang string")


def page(text, lang=None):
    return f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def test_text_decides_and_other_evidence_fills_in(spark, docs):
    rows = [(i, f"https://a{i % 3}.haus.de/x", page(WORDS["de"], "de-AT")) for i in range(30)]
    rows += [(100 + i, f"http://www.site.com/{i}", page(WORDS["en"], "en")) for i in range(30)]
    rows += [(200, "https://a1.haus.de/y", page("")), (201, None, None), (202, "http://www.site.com/z", page(WORDS["fr"], "en")), (203, "http://1.2.3.4/", page("", "en")), (202, "", "")]
    got = {}
    for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect():
        assert 0 < r.confidence <= 1.000001
        got.setdefault(r.page_id, []).append((r.lang, r.text_lang, r.declared, r.host))
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0][:3] == ("de", "de", "de") for i in range(30)) and all(got[100 + i][0][0] == "en" for i in range(30))
    assert got[200] == [("de", None, None, "a1.haus.de")] and ("fr", "fr", "en", "www.site.com") in got[202] and got[203][0][:3] == ("en", None, "en")


def test_own_vote_does_not_count_for_the_host(spark, docs):
    rows = [(i, f"http://only{i}.org/", page(WORDS["fr"][:4])) for i in range(3)]
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).toPandas()
    assert got.confidence.nunique() == 1


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(none, docs).count() == 0
    one = spark.createDataFrame([(1, "u", page(WORDS["en"]))], none.schema)
    assert [r.lang for r in language.identify(one, docs.limit(0)).collect()] == [None]


@pytest.mark.parametrize("url, want", [("https://u:p@A.B.example.ORG:80/x", ("a.b.example.org", "example.org", "org")), ("mailto:x", (None, None, None)),
                                       ("http://10.0.0.1/", ("10.0.0.1", "0.1", None)), (None, (None, None, None)), ("http://localhost", ("localhost", "localhost", None))])
def test_addresses(url, want):
    assert language.address(url) == want
