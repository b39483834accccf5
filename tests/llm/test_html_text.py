import itertools
import random
import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from costloom.llm import html_text


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def fitted(pages):
    return html_text.fitted(pages)


@pytest.fixture(scope="module")
def model(fitted):
    return html_text.Boosted.of(fitted)


def text_of(model, source):
    page = html_text.Page(source)
    return "\n\n".join(page.decode(model.probability(page.features())))


def article_of(source):
    """The given pages' articles by their own template: blocks are what stands between block tags."""
    import html

    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|article)>", inner)
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks) if t)


def test_given_pages(pages, model):
    got = {r.page_id: r for r in html_text.main_text(pages, model, keep=["page_id", "url"]).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    same = sum(got[r.page_id].text == article_of(r.html) for r in rows)
    assert same == len(rows)
    assert all(g.n_chars == len(g.text) for g in got.values())


LONG = "This is a sentence of the story, and it goes on for a while. " * 4


def test_other_shapes(model):
    body = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>Second&nbsp;part,\n {LONG}<br>end</p>"
    want = f"Title & more\n\n{LONG.strip()}\n\nSecond part, {LONG.strip()} end"
    junk = [
        "<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>",
        f'<aside><h3>Related</h3><p>{LONG}</p></aside><div class="sidebar"><p>Read this</p></div>',
        f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div></section>',
        '<form><p>Subscribe now</p><input name=q><button>Go</button></form><footer>&copy; 2024 Someone</footer>',
        '<script>var x = "<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><noscript>no</noscript>',
        '<div class="cookie-notice">We use cookies.</div><div id="ad-top">Buy now</div>',
    ]
    for shell in ("<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<article><div>{}</div></article>"):
        page = "<html><head><title>No</title></head><body>" + "".join(junk[:2]) + shell.format(body) + "".join(junk[2:]) + "</body></html>"
        assert text_of(model, page) == want, shell
    inside = f"<article>{body}{junk[2]}{junk[5]}</article>"
    assert text_of(model, f"<body>{junk[0]}{inside}{junk[3]}</body>") == want


LL = LONG.strip()
KEPT = {  # what may stand between two paragraphs of an article, and its text
    f'<p><a href="/x">{LONG}</a></p>': [LL],
    '<p><a href="/x">See the report</a></p>': ["See the report"],
    '<ul><li><a href="/1">First source used</a></li><li><a href="/2">Second source used</a></li></ul>': ["First source used", "Second source used"],
    "Bare text of the article here.": ["Bare text of the article here."],
    f'<div class="market-share"><p>{LONG}</p><p>{LONG}</p></div>': [LL, LL],
    f'<section id="login-flow"><p>{LONG}</p></section>': [LL],
    f'<div class="ad-hoc networks"><p>{LONG}</p></div>': [LL],
    f'<section class="social-history"><h2>Then</h2><p>{LONG}</p></section>': ["Then", LL],
    f'<p class="tag-line">{LONG}</p>': [LL],
    "<blockquote>Short quote.</blockquote>": ["Short quote."],
    "<h2>Part two</h2>": ["Part two"],
    "<table><tr><td>12</td><td>34</td></tr></table>": ["12", "34"],
    "<figure><img src=a><figcaption>A caption.</figcaption></figure>": ["A caption."],
    "<ul><li>One thing</li><li>Another thing</li></ul>": ["One thing", "Another thing"],
    "<div>Plain line</div>": ["Plain line"],
    "<pre>code x</pre>": ["code x"],
    "<dl><dt>Term</dt><dd>Meaning of it</dd></dl>": ["Term", "Meaning of it"],
}
LEFT_OUT = [
    f'<section id="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div></section>', '<div class="ad">Buy now</div>', '<div id="ad-top">Buy now</div>', f"<aside><p>{LONG}</p></aside>",
    '<div class="related"><ul><li><a href="/1">Other story</a></li><li><a href="/2">More of it</a></li></ul></div>', "<form><p>Subscribe now</p><label>Mail</label></form>",
    '<ul class="share-links"><li><a href="/1">Post it</a></li><li><a href="/2">Send it</a></li></ul>', f'<div class="newsletter-box"><p>{LONG}</p></div>', '<div class="cookie-notice">We use cookies.</div>',
    '<nav><a href="/">Back</a></nav>', "<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two more</a></li></ul></nav>", "<footer><p>Posted in News</p></footer>", '<div id="respond"><p>Leave a reply</p></div>',
    '<section class="promo sticky"><h3>Deal</h3><p>Now cheap</p></section>',
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<article><div>{}</div></article>"])
def test_what_stands_in_an_article(model, shell):
    def found(inner):
        body = shell.format(f"<h1>Title of it</h1><p>{LONG}</p>{inner}<p>{LONG}</p>")
        return text_of(model, f'<html><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>{body}<footer>&copy; 2024 Someone</footer></body></html>')

    for inner, want in KEPT.items():
        assert found(inner) == "\n\n".join(["Title of it", LL, *want, LL]), inner
    for inner in LEFT_OUT:
        assert found(inner) == "\n\n".join(["Title of it", LL, LL]), inner


def test_unnamed_divisions(model):
    p = f"<div>{LONG}</div>"
    assert text_of(model, f"<body><div><a href=/>Home</a> <a href=/>News</a></div><div><h1>Title of it</h1>{p}{p}</div><div>All rights reserved. Imprint</div></body>") == "\n\n".join(["Title of it", LL, LL])
    assert text_of(model, f"<body>{p}{p}{p}<div>All rights reserved. Imprint</div></body>") == "\n\n".join([LL] * 3)
    assert text_of(model, f"<body><div>{p}{p}</div><div>&copy; 2024 Example Inc. Privacy</div></body>") == "\n\n".join([LL] * 2)


def test_names_count_as_a_whole():
    assert html_text.told('class="market-share" id=login-flow') == (0, 0)
    assert html_text.told('class="share-box post-content"') == (1, 1)
    assert html_text.told("role=navigation id='cookie_notice'") == (2, 0)
    assert html_text.told("class='top-story ad-2'") == (1, 1)


def test_cases(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p"), (None, "u", "<nav>x</nav>"), (4, "u", "<article><p>a<p>b"), (4, "u", "<article><p>a<p>b"), (5, "u", "<article><p>" + "word. " * 100_000)]
    df = spark.createDataFrame([(*r, r[0], r[0]) for r in rows], "page_id long, url string, html string, text long, n_chars long")
    out = html_text.main_text(df, model).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[2] == "" and by[None] == "" and by[5] == ("word. " * 100_000).strip()
    none = df.filter("page_id > 99")
    assert html_text.train(none) is None and html_text.main_text(none, None).collect() == []
    plain = html_text.main_text(spark.createDataFrame([(1, "<nav>x</nav><div>y</div>")], "page_id long, html string"), None).collect()
    assert plain[0].text == "y"


def test_no_holder_under_a_node_that_holds_none():
    import numpy as np

    page = html_text.Page("<div><div><p>x</p></div></div>")
    p = np.array([0.9, 0.9, 0.01, 0.6, 0.6])
    assert page.decode(p) == []
    assert page.decode(np.array([0.9, 0.9, 0.4, 0.9, 0.9])) == ["x"]


def test_dropped_elements_end_where_html_ends_them():
    def texts(source):
        return [t for t in html_text.Page(source).text if t]

    assert texts("<p>A<svg-icon name=x></svg-icon></p><p>B</p>") == ["A", "B"]
    for tag in ("video-player", "button-group", "title-card", "option-x", "head-line"):
        assert texts(f"<{tag}><p>A</p></{tag}><p>B</p>") == ["A", "B"], tag
    assert texts("<p>A<svg viewBox='0 0 1 1'/>b</p><p>C</p>") == ["Ab", "C"]
    assert texts("<svg><title/><style/><path d=x /></svg><p>A</p>") == ["A"]
    assert texts("<p>A<svg><text>no</text><svg>no</svg>no</svg>b</p><p>C</p>") == ["Ab", "C"]
    assert texts("<svg><path d=x><p>A</p><footer>B</footer></svg>") == ["A", "B"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject></svg><p>A</p>") == ["A"]
    assert texts("<datalist><option>x<option value=1>y</datalist><p>A</p>") == ["A"]
    for tag in html_text.DROPPED - {"svg"}:
        assert texts(f"<body><div><{tag}>no</div><p>A</p></body>") == ["A"], tag
        assert texts(f"<body><{tag}>no<article><p>A</p></article></body>") == ["A"], tag
        assert texts(f"<{tag}>no<p>A</p><{tag}>no</{tag}><p>B") == ["A", "B"], tag
        assert texts(f"<{tag} a='>'>no<div>no</div><!-- </{tag}> --></{tag}><p>A") == ["A"], tag
    assert texts("<head><title>t</title><p>A") == ["A"]
    assert texts("<html><head><meta charset=x><title>t</title><script>a<b</script></head><body><p>A") == ["A"]
    assert texts("<!--><p>A</p><!---><p>B</p><!-- no --!><p>C</p><!-- no -->") == ["A", "B", "C"]
    assert texts("<p>A</p><script>no") == ["A"]
    assert len(texts("<video>no<p>A" * 20_000)) == 20_000


SHAPES = [
    "<body><nav><a href=x>Home</a></nav><div class=post><p>One two three, four.</p><p>Five six.</p></div><footer>f</footer></body>",
    "<div id=main><h1>Title</h1><p>A b c d e f g, h.</p><div class=comments><p>Nice!</p></div></div>",
    "<p>only</p>",
    "<table><tr><td class=sidebar>s</td><td><p>Text of the page, long enough to count.</p></td></tr></table>",
]


def spark_probabilities(spark, fitted, pages):
    """Of each page's nodes, by Spark's own model."""
    rows = [(k, i, Vectors.dense(x.astype(float))) for k, p in enumerate(pages) for i, x in enumerate(p.features())]
    found = fitted.transform(spark.createDataFrame(rows, ["k", "i", "features"])).collect()
    return [np.array([r.probability[1] for r in sorted((r for r in found if r.k == k), key=lambda r: r.i)]) for k in range(len(pages))]


def test_trees_give_what_spark_gives(spark, fitted, model, pages):
    forms = [html_text.Page(s) for s in SHAPES] + [html_text.Page(r.html) for r in pages.limit(5).collect()]
    for page, want in zip(forms, spark_probabilities(spark, fitted, forms)):
        assert np.allclose(model.probability(page.features()), want, atol=1e-9)


def brute_decode(page, p):
    """The likeliest of all labellings in which a node that holds has a parent that does."""
    n, best = len(page.parent), None
    p = np.clip(p, 1e-4, 1 - 1e-4)
    for bits in itertools.product((False, True), repeat=n - 1):
        held = (True, *bits)
        if all(held[page.parent[i]] or not held[i] for i in range(1, n)):
            score = sum(np.log(p[i]) if held[i] else np.log(1 - p[i]) for i in range(n))
            if best is None or score > best[0] + 1e-9:
                best = score, held
    return [t for t, h in zip(page.text, best[1]) if t and h]


def test_decode_equals_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        page = html_text.Page("")
        for i in range(1, rng.randrange(2, 11)):
            page.parent.append(rng.randrange(i))
            page.text.append(f"t{i}" if rng.random() < 0.7 else "")
        p = np.array([rng.random() for _ in page.parent])
        assert page.decode(p) == brute_decode(page, p)


def test_query_equals_brute_force(spark, fitted, model):
    """The operator on a table of small pages against Spark's model and all labellings."""
    rows = [(i, f"u{i}", s) for i, s in enumerate(SHAPES)] + [(9, "u9", None), (10, "u10", "")]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model, keep=["page_id", "url"]).collect()}
    forms = [html_text.Page(s or "") for _, _, s in rows]
    for (i, url, _), page, p in zip(rows, forms, spark_probabilities(spark, fitted, forms)):
        want = "\n\n".join(brute_decode(page, p))
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_any_column_names(spark, model):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>")], "`page id: x` long, `u,rl` string, html string")
    out = html_text.main_text(df, model, id_col="page id: x", keep=["page id: x", "u,rl"])
    assert out.columns == ["page id: x", "u,rl", "text", "n_chars"] and out.count() == 1


def test_unclosed_and_custom_elements(model):
    article = "<article><p>" + "The body of the page has words, and they go on for a while. " * 3 + "</p></article>"
    want = " ".join(("The body of the page has words, and they go on for a while. " * 3).split())
    for before in ("<video-js id=x></video-js>", "<datalist><option>A<option>B</datalist>", "<button-group></button-group>", "<!-->", "<select><option>x<option>y</select>"):
        assert want in text_of(model, before + article)
    assert text_of(model, "<article><p>a<svg-icon></svg-icon>b</p><p>tail</p></article>").endswith("tail")
