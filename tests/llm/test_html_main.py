import itertools
import random
import time

from pyspark.sql import functions as F

from quillgrain.llm import html_main as h


def value(odds, edges, label):
    return sum(o for o, x in zip(odds, label) if o > 0 and not x) + sum(-o for o, x in zip(odds, label) if o < 0 and x) + sum(c for a, b, c in edges if label[a] != label[b])


def test_cut_is_least():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(2 * n)]
        got = value(odds, edges, h.minimum_cut(odds, edges))
        assert got == min(value(odds, edges, x) for x in itertools.product([False, True], repeat=n))


PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies, please accept them all. This sentence is long enough to look like prose, isn't it, dear reader?</p></div>
<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class=sidebar><p>Most read stories of the week, all of them in one long list that goes on and on and on for a good while, really.</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First  para&nbsp;graph with <a href="#">a link</a> inside.<p>Se<b>con</b>d.<br>Line</p><!-- no --><ul><li>Item</ul>
<div class="ad">Buy this!</div><form><p>Subscribe</p></form><p>Last &lt;tag&gt; 😀</p><section class="comments"><p>A reader's comment that is as long as any paragraph of the article itself, with a full stop at its end.</p></section></article>
<aside><p>Related</p></aside><footer><p>&copy; Us</p></footer><script>x</script></body></html>"""


def test_article_without_the_rest():
    assert h.main_text(PAGE) == "Head & line First para graph with a link inside. Second. Line Item Last <tag> 😀"


def test_without_article_tag():
    body = "".join(f"<p>Paragraph number {i} says something of some length, so that it looks like prose to anybody.</p>" for i in range(4))
    page = f"<body><ul class=menu><li><a href=a>A</a><li><a href=b>B</a></ul><div id=content>{body}</div><div id=footer>Imprint</div></body>"
    assert h.main_text(page).startswith("Paragraph number 0") and h.main_text(page).endswith("anybody.") and "Imprint" not in h.main_text(page)


def test_broken_pages():
    for page in (None, "", "<", "<p", "<!-- never closed", "<script>x", "<article>", "</p></div>", "<p>a<p title=\"x>b", "&#0;&bogus;"):
        assert isinstance(h.main_text(page), str)
    assert h.main_text("<article><p>cut off <b") == "cut off"
    assert h.main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"


def test_long_page():
    page = "<article>" + "<p>word word.</p>" * 20_000 + "</article>"
    assert len(h.main_text(page)) == 20_000 * 11 - 1


def blank_edges(page, weights=h.PRIOR):
    found = h.blocks(page)
    return " ".join(b.text for b, c in zip(found, h.block_costs(found, weights)) if c > 0)


def test_edges_keep_short_lines():
    """Link lines between paragraphs of an article read like a menu; only their neighbours keep them."""
    prose = "<p>A paragraph of some length that reads like prose, more or less, to anybody at all.</p>"
    page = f"<nav><a href=/>Home</a></nav><article>{prose}<p><a href=x>Source</a></p>{prose}<div><p><a href=y>Another source</a></p></div>{prose}</article><footer>Imprint</footer>"
    want = h.blocks(page)[1:-1]
    assert h.main_text(page) == " ".join(b.text for b in want) != blank_edges(page)
    assert h.cut_flips(page) == (7, 2)


def test_neighbours_decide_where_nothing_is_clear():
    prose = "<p>A paragraph of some length that reads like prose, more or less, to anybody at all.</p>"
    page = f"<body><div>{prose * 3}<p>No</p>{prose * 3}</div><div><a href=a>One</a></div><div><a href=b>Two</a></div></body>"
    assert " No " in h.main_text(page) and " No " not in blank_edges(page) and "One" not in h.main_text(page)
    assert h.cut_flips(page)[1] > 0


KEPT_NAMES = ["class=share-price", "class='social-history'", 'id="related-work"', "class=promotion", "class=alert", "class=discussion", "class='article-comments-policy'", "title=it's", "class=ad-hoc", "id=menu-planning"]
DROPPED_NAMES = ["class=ad", "class='ad-slot'", "class=cookie-notice", "id=comments", "class='share-buttons'", "class=relatedPosts", "class='x newsletter-signup'", "hidden", "role=navigation"]


def test_names_in_articles():
    """A name counts if all its parts do; text of an article isn't lost for others."""
    line = "The committee met again on Tuesday, and it didn't come to a decision on the matter."
    for name in KEPT_NAMES:
        assert h.main_text(f"<article><h1>Title here</h1><p {name}>{line} 1</p><div {name}><p>{line} 2</p></div><p>{line} 3</p></article>") == f"Title here {line} 1 {line} 2 {line} 3", name
    for name in DROPPED_NAMES:
        assert h.main_text(f"<article><h1>Title here</h1><p>{line} 1</p><div {name}><p>{line} 2</p></div><p>{line} 3</p></article>") == f"Title here {line} 1 {line} 3", name


def test_generated_pages_with_misleading_names():
    """Boilerplate around articles whose paragraphs bear such names, in random order and nesting."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    turned = 0
    for _ in range(150):
        want, parts = [said(5)], []
        for _ in range(rng.randint(2, 8)):
            text, name = said(rng.choice([2, 6, 20, 60])), rng.choice(["", "", *(n for n in KEPT_NAMES)])
            want.append(text)
            parts.append(rng.choice([f"<p {name}>{text}</p>", f"<div {name}><p>{text}</div>", f"<ul {name}><li>{text}</ul>"]))
            if rng.random() < 0.3:
                text = word()
                want.append(text)
                parts.append(f"<p><a href=x {name}>{text}</a></p>")
                text = said(30)
                want.append(text)
                parts.append(f"<p>{text}</p>")
            if rng.random() < 0.3:
                parts.append(f"<div {rng.choice(DROPPED_NAMES)}><p>{said(12)}</p></div>")
        menu = "".join(f"<li><a href={i}>{word()}</a>" for i in range(5))
        page = f"<header>{word()}</header><nav><ul>{menu}</ul></nav><div class=ad>{said(9)}</div><article><h1>{want[0]}</h1>{''.join(parts)}</article><aside><p>{said(15)}</p></aside><footer>{said(8)}</footer>"
        assert h.main_text(page) == " ".join(want)
        turned += h.cut_flips(page)[1]
    assert turned > 20


def test_formulas_and_quotes():
    assert h.main_text("<p title=it's>First line of it.</p><p>Second isn't lost.</p>") == "First line of it. Second isn't lost."
    assert h.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == "So x=2 holds."
    assert h.main_text("<article><p data-x='a>b' title=\"c>d\">One.</p><p title=\"never closed>Two.</p></article>").startswith("One.")


def test_labels_against_all_labellings():
    """Dropping the nodes that are cut anyway leaves a least cut of the whole page."""
    rng = random.Random(5)
    for _ in range(80):
        n = rng.randint(1, 9)
        odds = [rng.choice([-600, 600, 0, *range(-90, 90, 7)]) for _ in range(n)]
        edges = [(i, i + 1, rng.randint(0, 60)) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), 30) for _ in range(n)]
        edges = [e for e in edges if e[0] != e[1]]
        assert value(odds, edges, h.label_blocks(odds, edges)) == min(value(odds, edges, x) for x in itertools.product([False, True], repeat=n))


def test_classifier_learns_from_clear_blocks(spark):
    """Here content is short and boilerplate long: the corpus turns the prior round, for pages without clear elements too."""
    content, other = "<p>ok</p>", "<p>" + "very long words without any sense in them " * 9 + "</p>"
    clear = f"<article>{content * 3}</article><footer>{other}</footer><aside>{other}</aside>"
    pages = spark.createDataFrame([(i, "u", clear + f"<!-- {i} -->") for i in range(40)] * 2, "page_id long, url string, html string")
    weights = h.learn_weights(pages)
    bare = f"<div>{content * 2}</div><div><div><div>{other}</div></div></div>"
    assert h.main_text(bare, weights) == "ok ok" and "ok" not in h.main_text(bare)
    assert (h.learn_weights(pages.limit(3)) == h.PRIOR).all() and (h.learn_weights(pages.limit(0)) == h.PRIOR).all()


def test_deep_and_wide_pages_stay_fast():
    deep = "<div>" * 50_000 + "<p>some text here.</p>" + "</div>" * 50_000
    for page in (deep, "<div><li>x" * 20_000, "<ul><li>" * 20_000 + "text", "<div><span>a</span>" * 20_000, "<p>Some words, of some length here</p><li>a</li>" * 10_000):
        began = time.perf_counter()
        h.main_text(page)
        assert time.perf_counter() - began < 5


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "x", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = h.extract_pages(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 79), ("1", 79), ("2", 0), ("None", 0)]
    assert h.extract_pages(pages.limit(0)).count() == 0
