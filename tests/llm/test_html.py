from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- hidden -->
<article><h1>Head &amp; line</h1><p>First   <b>bold</b>
text.<p>Second &lt;kept&gt;<br>line.</p><div class="ad">Buy now</div><p>Ok.</p><div id="comments"><p>A reader says</p></div></article>
<aside>Side</aside><form><input value=x>Search</form><footer>&copy; Foot</footer></body></html>"""


def test_article_alone():
    assert H.extract(PAGE) == "Head & line\n\nFirst bold text.\n\nSecond <kept> line.\n\nOk."


def test_page_without_marks_by_its_lines():
    body = "".join(f"<div>{'Long text with many words in a row. ' * 4}{i}</div>" for i in range(5))
    page = f"<div><a>A</a></div><div><a>B</a></div><div><a>C</a></div>{body}<div><a>D</a></div><div><a>E</a></div><div><a>F</a></div><div>tiny</div>"
    found = H.extract(page).split("\n\n")
    assert len(found) == 5 and found[0].endswith("0") and found[-1].endswith("4")


def test_frames_are_no_furniture():
    inner = "<div class='entry'>" + "Some long text of the page itself, in one block. " * 3 + "</div>"
    for frame in ("page with-sidebar", "has-sidebar", "content no-ads", "wrap"):
        assert H.extract(f"<div class='{frame}'>{inner}<div class='sidebar-box'>{'Other things to read here. ' * 6}</div></div>").startswith("Some long text")
        assert "Other things" not in H.extract(f"<div class='{frame}'>{inner}<div class='sidebar-box'>{'Other things to read here. ' * 6}</div></div>")


def test_broken_markup():
    assert H.extract("<article><p>a<b>b<p>c</article>") == "ab\n\nc"
    assert H.extract("1 < 2 & 3") == "1 < 2 & 3"
    assert H.extract('<p title="a > b">x</p><p title="open>y</p>') != ""
    assert H.extract("<nav>only") == "" and H.extract("") == "" and H.extract(None) == ""
    assert H.extract("<article>" + "<div>" * 3000 + "deep") == "deep"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/ab=\"'&; \npdiv!-", max_size=80))
def test_never_fails(page):
    assert isinstance(H.extract(page), str)


def test_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9), (1, "u", PAGE, 9)], "page_id long, url string, html string, text int")
    found = H.extract_pages(rows)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, len(r.text)) for r in found.collect()) == [(0, 0), (1, len(H.extract(PAGE))), (1, len(H.extract(PAGE))), (2, 0)]
    assert H.extract_pages(rows.limit(0)).collect() == []


def test_story_beside_marked_teasers():
    story = "".join(f"<p>{'A sentence of the story that the page tells. ' * 6}{i}</p>" for i in range(6))
    cards = "".join(f"<article><h3>Card {i}</h3><p>Short words about another page.</p></article>" for i in range(3))
    for page in (f"<div>{story}</div>{cards}", f"{cards}<div>{story}</div>", f"<div>{story}</div><nav>Go</nav>{cards}"):
        found = H.extract(page).split("\n\n")
        assert sum(line.startswith("A sentence of the story") for line in found) == 6
    assert "Card" not in H.extract(f"<div>{story}</div><nav>Go</nav>{cards}")
    assert "Card" not in H.extract(f"<article>{story}</article><div><p>Card</p></div>")


LONG = "A sentence of the story that the page tells. " * 6
STORY = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
TOLD = [f"{LONG}{i}" for i in range(4)]


def test_elements_that_look_like_others():
    for before in ('<svg viewBox="0"/>', "<video-player src=x></video-player>", "<object-card>", "<script src=a />", "<svg><path d='M0'/></svg>", "<math/>", "<template><p>no</p></template>"):
        assert H.extract(f"<article>{before}{STORY}</article>").split("\n\n") == TOLD, before
    assert H.extract(f"<article>{STORY}<script>var x = '<p>no</p>'</article>").split("\n\n") == TOLD
    assert H.extract(f"<article><video src=x>no</article><p>out</p><article>{STORY}</article>").split("\n\n") == TOLD


def test_furniture_words_in_prose():
    page = f"<article><p>a <span class='search-highlight'>treasure</span> b</p><p class='related-work'>Related work.</p>{STORY}<p class='cookie-notice'>no</p></article>"
    assert H.extract(page).split("\n\n") == ["a treasure b", "Related work.", *TOLD]


def test_short_parts_of_a_story_stay():
    ad = "<div class='ad'>Buy now</div>"
    for page in (f"<div class=story>{STORY}{ad}<p>Short end.</p></div><div>foot</div>", f"<div><section>{STORY}</section>{ad}<section><p>Short end.</p></section></div>", f"<article>{STORY}{ad}<p><a>Short end.</a></p></article>"):
        assert H.extract(page).split("\n\n") == [*TOLD, "Short end."]
    assert H.extract(f"<body><ul><li><a>A</a></ul>{STORY}{ad}<p>Short <a>middle of links and more links</a></p>{ad}{STORY}{ad}<p>tiny</p></body>").split("\n\n") == [*TOLD, "Short middle of links and more links", *TOLD]


def plain_windows(weights):
    """Segments by hand: a window begins at each line and covers it and the next ones; also those before the first line count."""
    out, n = [], len(weights)
    sums = [sum(weights[max(i, 0) : i + H.WINDOW]) for i in range(n)]
    start = None
    for i in range(n + 1):
        if i < n and sums[i]:
            start = i if start is None else start
        elif start is not None:
            out.append((start, i, max(sums[start:i])))
            start = None
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 5, 90, 400]), max_size=40))
def test_segments_against_plain_windows(weights):
    assert H._segments(weights) == plain_windows(weights)


def test_pages_of_the_table(spark):
    """Every sample page's article, cut out by its tags alone."""
    import html
    import re

    for row in H.extract_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|li|ul)>", inner)]
        assert row.text == "\n\n".join(x for x in blocks if x)
