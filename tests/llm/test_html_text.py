import html
import re

import pytest
from llm.html_text import Node, block_texts, core_and_threshold, extract_main_text, main_text, measure, parse


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") : r.html.rindex("</article>")]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", inner))
        assert got[r.page_id].text == " ".join(html.unescape(text).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert len(got) == pages.count()


BODY = "<p>One long paragraph with many words in it, and no link at all.</p>"


def test_boilerplate_goes():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies</div><div id="content"><h1>A &amp; B</h1>{BODY}<div class="ad">Buy</div>{BODY}
    <form><label>Name</label><input value=v></form><script>var a="<p>no</p>";</script><!-- gone --><div class="comments"><p>Nice post, I liked it a lot.</p></div></div>
    <aside>Side</aside><footer>&copy; me</footer></body></html>"""
    plain = "One long paragraph with many words in it, and no link at all."
    assert main_text(page) == f"A & B {plain} {plain}"


def test_unclosed_and_nested_markup():
    assert main_text("<article><p>a<b>b<p>c\n d<ul><li>e<li>f</ul>g</article>") == "ab c d e f g"
    assert main_text("no markup,  just\ntext &lt;3") == "no markup, just text <3"
    assert main_text("<p>x</p></div></p><p>y") == "x y"


def test_link_lists_lose_to_text():
    links = "".join(f'<li><a href="/{i}">somewhere {i}</a></li>' for i in range(50))
    page = f"<body><div><ul>{links}</ul></div><div>{BODY * 3}</div></body>"
    assert "somewhere" not in main_text(page) and main_text(page).count("paragraph") == 3


def test_density_falls_with_links():
    root = parse(f"<body><div>{BODY}</div><div><p><a>{'x' * 50}</a></p></div></body>")
    body = measure(root)
    plain, linked = [c for c in body.children if not isinstance(c, str)]
    assert plain.density > linked.density
    assert block_texts(plain) == [BODY[3:-4]]


def test_odd_rows(spark):
    rows = [(1, None, None, 0), (2, "u", "", 0), (None, "u", " \n", 0), (4, "u", "<", 0), (4, "u", "<p>" + "w " * 200_000, 0), (5, "u", "<div>" * 3000 + "deep", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_main_text(df).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (None, 0), (4, 1), (4, 399_999), (5, 4)]
    assert extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "has-header", "page menu-open"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_wrappers_drop_nothing(name, tag):
    prose = " ".join(f"word{i}" for i in range(60))
    page = f"<body><div class='{name}'><{tag}><p>{prose}</p><p class='legal'>The law says so in many words.</p></{tag}></div><div class='sidebar'><a href=x>more</a></div></body>"
    assert main_text(page) == f"{prose} The law says so in many words."


def test_names_of_links_and_ads_still_drop():
    prose = " ".join(f"word{i}" for i in range(60))
    page = f"<body><article><p>{prose}</p><p class='ad'>Buy this now.</p><div class='related'><a href=x>Another story</a></div></article></body>"
    assert main_text(page) == prose


def article_of(page):
    inner = page[page.index("<article>") : page.rindex("</article>")]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", inner))).split())


def test_density_alone_finds_most_articles():
    """No tag, role or class tells anything here: every container is a plain div."""
    import pyarrow.parquet as pq

    found = 0
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        blank = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")
        found += main_text(blank, lists=False) == article_of(page)
        assert main_text(re.sub(r"<(/?)article>", r"<\1div>", page)).endswith(article_of(page)[-40:])
    assert found >= 0.8 * len(pages)


def test_links_beside_the_article_in_one_wrapper():
    links = "".join(f"<a href='/{i}'>link number {i}</a> " for i in range(30))
    prose = "".join(f"<p>Paragraph {i} has a good number of plain words in it, more than any link has.</p>" for i in range(5))
    got = main_text(f"<body><div id=w><div class=c1>{prose}</div><div class=c2>{links}</div></div></body>")
    assert "link number" not in got and got.count("Paragraph") == 5
    got = main_text(f"<body><div id=w><h2>Title</h2><div class=c1>{prose}</div><div class=c2><ul>{links}</ul></div></div></body>")
    assert got.startswith("Title Paragraph 0") and "link number" not in got and got.count("Paragraph") == 5


def test_articles_in_parts():
    part = lambda name, n: "<section>" + "".join(f"<p>{name} {i} goes on for some time, with words enough for a paragraph.</p>" for i in range(n)) + "</section>"
    got = main_text(f"<body><div><a href=/>Home</a> <a href=/b>Blog</a></div><div><h1>Story</h1>{part('First', 6)}{part('Second', 4)}{part('Third', 5)}</div></body>")
    assert (got.count("First"), got.count("Second"), got.count("Third"), got.startswith("Story")) == (6, 4, 5, True) and "Home" not in got


@pytest.mark.parametrize("tag", ["button", "noscript", "select", "svg", "object"])
def test_unclosed_skipped_elements_end_at_the_next_block(tag):
    assert main_text(f"<body><article><p>one</p><{tag}>not this<p>two words</p><div>three</div></article></body>") == "one two words three"
    assert main_text(f"<body><article><p>one</p><{tag}>not this<p>nor this</p></{tag}><p>two</p></article></body>") == "one two"


def test_unclosed_elements_within_unclosed_elements():
    assert main_text("<p>a</p><button>x<div>b<noscript>y<p>c</p></div><p>d") == "a b c d"


def test_stray_end_tags_in_deep_pages():
    page = "<div>" * 20_000 + "text" + "</b></p></span>" * 40_000
    assert main_text(page) == "text"


def by_hand(node, body):
    """C, T, LC, LT by walking the whole subtree for each node."""
    import math

    def walk(n, in_link):
        c = t = lc = lt = 0
        for x in n.children:
            if isinstance(x, str):
                k = len("".join(x.split()))
                c, lc = c + k, lc + (k if in_link else 0)
            else:
                a, b, d, e = walk(x, in_link or x.tag == "a")
                c, t, lc, lt = c + a, t + 1 + b, lc + d, lt + e + (x.tag == "a")
        return c, t, lc, lt

    c, t, lc, lt = walk(node, node.tag == "a")
    bc, _, blc, _ = walk(body, False)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e)
    return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / max(0.1, math.log(base))


def test_densities_by_hand():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()[:25]:
        root = parse(page)
        body, stack, nodes = measure(root), [root], []
        while stack:
            node = stack.pop()
            nodes.append(node)
            stack.extend(c for c in node.children if isinstance(c, Node))
        for node in nodes:
            assert node.density == pytest.approx(by_hand(node, body), rel=1e-12)
        core, threshold = core_and_threshold(body)
        path, node = [core.density], core
        while node is not body:
            node = node.parent
            path.append(node.density)
        assert threshold == min(path)
