import pytest

from wiretide.llm import pages

LONG = "The quick story of the day is that it was told in the town and by the sea, as they have it from all of the people who were there. " * 2


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html></html>", ""),
    ("<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><a href=x>Menu</a></nav>"
     "<div class='ad'>Buy this and that of the best.</div><article><h1>Head</h1><p><b>One &amp;   two<br><p>x&nbsp;&lt;y&gt;</article><footer>&copy; all</footer>",
     "Head\nOne & two\nx <y>"),
    ("<body><article><p>Text one.</p><aside>Side</aside><div class='comments'><p>A reader says</p></div><ul><li>item</li><li><a href=y>only a link</a></li></ul>"
     "<form><p>Sign</p></form><p>Text two.</p></article>", "Text one.\nitem\nText two."),
    (f"<div id=menu><p>Home</p></div><div><h2>Short head</h2><p>{LONG}</p><p>Short tail.</p></div><div class='cookie-notice'>{LONG}</div><p>(c) us</p><div>"
     "<a href=1>a link</a> <a href=2>more links here</a></div>", "Short head\n" + LONG.strip() + "\nShort tail."),
    ("<p>Hello, page", "Hello, page"),
    ("<article><p>a<!-- <p>no --> b</p><script>x", "a b"),
    ("<article><p title=\"a > b\">kept<p>line<br><br>next<td>cell</article>", "kept\nline\nnext\ncell"),
    ("<article><header><h1>In the article</h1></header><p class='share'>Share</p><p>Body</p></article><header>Site</header>", "In the article\nBody"),
])
def test_rules(page, want):
    assert pages.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    ('<article class="has-comments"><p>Body</p></article>', "Body"),
    ('<div class="content no-sidebar"><article><p>Body</p></article></div>', "Body"),
    ('<article><div class="article-header"><h1>Head</h1></div><p>Body</p><div class="post-comments"><p>Reader</p></div></article>', "Head\nBody"),
    ('<article><p>Before</p><svg><path d="M0"><p>After</p></article><footer>end</footer>', "Before\nAfter"),
    ('<article><p>Before <svg><text>no</text></svg>it</p><select><option>no</select><iframe>no</iframe><p>After</p></article>', "Before it\nAfter"),
    ('<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>', "so x=1 holds"),
    ('<article><p>Text</p><p><a href=x>The whole paragraph is a link</a></p><div class="ad-slot"><p>Buy</p></div><div id=siteNav><p>Go</p></div></article>',
     "Text\nThe whole paragraph is a link"),
    ('<article class="comment"><p>Reader</p></article><main class="page-footer-light"><p>Body</p></main>', "Body"),
])
def test_names_and_open_elements_lose_no_text(page, want):
    assert pages.main_text(page) == want


def test_open_blocks_take_the_nearest_label():
    assert pages.first_pass("short", 0, "outside") is None and pages.first_pass(LONG, 0, "outside") is True
    assert pages.first_pass("xq zv " * 40, 0, "outside") is False and pages.first_pass("a link here", 11, "article") is False


RUSSIAN = "Вчера вечером жители города собрались на площади, чтобы обсудить новый план застройки набережной и парка у реки."
GREEK = "Το απόγευμα οι κάτοικοι της πόλης συγκεντρώθηκαν στην πλατεία για να συζητήσουν το νέο σχέδιο της παραλίας."
CHINESE = "昨天晚上市民聚集在广场上讨论新的滨河公园建设方案并提出了许多意见和建议"


@pytest.mark.parametrize("text", [RUSSIAN, GREEK, CHINESE])
def test_text_without_an_article_in_other_scripts_stays(text):
    menu = "<div><a href=1>" + text[:12] + "</a> <a href=2>" + text[12:24] + "</a></div>"
    page = f"<body>{menu}<div><h1>{text[:9]}</h1><p>{text}</p><p>{text} <a href=z>{text[:5]}</a> {text}</p></div>{menu}"
    assert pages.main_text(page) == f"{text[:9]}\n{text}\n{text} {text[:5]} {text}"
    assert pages.main_text(f"<body>{menu}<table><tr><td><p>{text}</p></td></tr></table>{menu}") == text
    notice = "<p>We use this site and the cookies of it to be with you all as it was.</p>"
    assert text in pages.main_text(page + notice)


def test_tables_lists_and_code_of_a_page_without_an_article_stay():
    code, item, cell = "x = [y ** 2 for y in range(100)]; print(x, x[0]); " * 3, "flour 500g, butter 250g, sugar 200g, eggs 4, milk 300ml, vanilla 1 pod", "Berlin 3,769,000; Hamburg 1,899,000; Munich 1,488,000; Cologne 1,086,000"
    page = f"<div><p>{LONG}</p><pre>{code}</pre><ul><li>{item}</li></ul><table><tr><td>{cell}</td></tr></table><p>{LONG}</p><ul><li><a href=x>{item}</a></li></ul></div>"
    assert pages.main_text(page) == "\n".join([LONG.strip(), code.strip(), item, cell, LONG.strip()])


def test_long_and_broken_pages_end():
    assert pages.main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert pages.main_text("<p>a" + "<svg><select>" * 60_000 + "<p>end") == "a\nend"
    assert pages.main_text("<div class=\"x" * 3000 + "<p>end") is not None and pages.main_text("<" * 5000) is not None


def test_every_page_is_returned(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in pages.extract(df).collect()) == [("1", "", 0), ("1", "é", 1), ("None", "", 0)]
    assert pages.extract(df.limit(0)).count() == 0
