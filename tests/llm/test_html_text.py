import random
from collections import Counter

import pytest

from gridloom.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string, host string, marks int"


def one(page):
    return " ".join(H.blocks(page)[0])


def run(spark, pages):
    df = spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], SCHEMA).repartition(3)
    return {r.page_id: r.text for r in H.extract(df).collect()}


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b  <b>c</b>d\n e<br>f</p>g", "a b cd e f g"),
        ("<title>t</title><body><nav><a>x</a></nav><article><h1>T&eacute;</h1><p>a &lt;b&gt; &#233;</p></article><footer>f</footer>", "Té a <b> é"),
        ("<div class='site-header'>h</div><main><h1>H</h1><article><p>a</p></article><div id=sidebar>s</div></main>", "H a"),
        ("<article><header><h1>H</h1></header><p>a</p><aside>x</aside><div class='share-bar'>s</div></article><article class='comment'>c</article>", "H a"),
        ("<article><p>a</p><section id='comments'><article><p>reader</p></article></section></article>", "a"),
        ("<form><input value=1><p>f</p></form><p>a</p>", "a"),
        ("<form id=aspnet><div><article><p>a</p></article></div></form>", "a"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>a</p><!-- <p>no</p> --><p title='x>y'>b</p><![CDATA[no]]>", "a b"),
        ("<p>a</p><script>never closed <p>b</p>", "a"),
        ("<p>a</p><!-- never closed <p>b</p>", "a"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("1 < 2 and <3 </ p> x", "1 < 2 and <3 x"),
        ("<body class='no-sidebar has-nav'><p>a</p><div class='cookie-notice'>c</div><div hidden>h</div><p style='display: none'>i</p></body>", "a"),
        ("<div class='content-with-sidebar'><article><p>a</p></article></div>", "a"),
        ("<p>a&nbsp;&nbsp;b\t\nc</p>", "a b c"),
        ("<P>A</P><SCRIPT>x</SCRIPT><DIV>b</DIV>", "A b"),
        ("<a href=\"x\" title='5\" tv'>l</a><a href=x\">m</a>n", "lmn"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_pages(page, want):
    assert one(page) == want


def test_templates_are_deleted_per_host(spark):
    pages = [(i, f"http://a.example/{i}", f"<div><div>Site name</div><p>own text {i} of page</p><div>More <b>links</b></div></div>") for i in range(12)]
    pages += [(100, "http://b.example/", "<div><div>Site name</div><p>x</p></div>")]
    got = run(spark, pages)
    assert all(got[i] == f"own text {i} of page" for i in range(12))
    assert got[100] == "Site name x"


def test_copies_don_t_make_templates(spark):
    page = "<article><h1>Head</h1><p>a long first paragraph</p><p>second</p></article>"
    pages = [(i, "http://c.example/x", page) for i in range(40)] + [(100 + i, "http://c.example/y", f"<article><p>other {i}</p></article>") for i in range(3)]
    got = run(spark, pages)
    assert all(got[i] == "Head a long first paragraph second" for i in range(40))


def test_widget_inside_articles(spark):
    pages = [(i, "http://d.example/x", f"<article><p>paragraph {i} here</p><div>Follow us everywhere</div></article>") for i in range(10)]
    assert run(spark, pages) == {i: f"paragraph {i} here" for i in range(10)}


def test_long_templates(spark):
    """Two blocks of template that are longer than the article go."""
    long = ["".join(f" template {k} word{i}" for i in range(30)) for k in range(2)]
    own = [f"this is the text of page number {i}, which is not so long" for i in range(30)]
    pages = [(i, "http://t.example/x", f"<div><div>{long[0]}</div><div>{own[i]}</div><div>{long[1]}</div></div>") for i in range(30)]
    assert run(spark, pages) == dict(enumerate(own))


def brute(pages):
    """Template deletion by dictionaries, from the blocks of each page."""
    parsed = [(i, H._HOST.match(u)[1], *H.blocks(p)) for i, u, p in pages]
    out = {}
    for host in {h for _, h, _, _ in parsed}:
        rows = [(i, t, m) for i, h, t, m in parsed if h == host]
        different = {tuple(t): set(t) for _, t, _ in rows}
        on = Counter(b for t in different.values() for b in t)
        common = {b for b, n in on.items() if n >= 5 and n >= 0.1 * len(different)}
        sign = lambda t: frozenset(set(t) - common) or tuple(t)
        marks = Counter(x for x, _ in {(x, sign(t)) for _, t, ms in rows for m in ms for x in m})
        of = len({sign(t) for _, t, _ in rows})
        template = {x for x, n in marks.items() if n >= 5 and n >= (0.3 if x % 2 else 0.1) * of}
        for i, t, ms in rows:
            out[i] = " ".join(b for b, m in zip(t, ms) if not template & set(m))
    return out


def test_deletion_against_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    pages = []
    for host in range(4):
        boxes = [f"<div><b>{words(r.choice([2, 30]))}</b><p>{words(4)}</p></div>" for _ in range(5)]
        for k in range(r.choice([3, 12, 40])):
            body = [f"<p>{words(r.randrange(1, 20))}</p>" for _ in range(r.randrange(1, 4))]
            body += [b for n, b in enumerate(boxes) if r.random() < (0.9, 0.5, 0.25, 0.08, 0.9)[n]]
            r.shuffle(body)
            tag = r.choice(["article", "div"]) if host else "article"
            for _ in range(r.choice([1, 1, 7])):
                pages.append((len(pages), f"https://h{host}.example/{k}", f"<body>{r.choice(boxes)}<{tag}>{''.join(body)}</{tag}></body>"))
    assert run(spark, pages) == brute(pages)


def test_odd_rows(spark):
    pages = [(1, None, None), (2, "no host", ""), (None, "http://e/", "<p>x</p>"), (3, None, "<p>" + "word " * 200_000 + "</p>"), (3, None, "<p>" + "word " * 200_000 + "</p>")]
    df = spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], SCHEMA)
    got = [(r.page_id, r.url, len(r.text), r.n_chars) for r in H.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 0, 0), (2, "no host", 0, 0), (None, "http://e/", 1, 1), (3, None, 999_999, 999_999), (3, None, 999_999, 999_999)], key=str)
    assert H.extract(df.limit(0)).count() == 0


def test_code_points(spark):
    df = spark.createDataFrame([(1, "http://e/", "<p>a&#128512;é</p>")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in H.extract(df).collect()] == [("a😀é", 3)]


@pytest.mark.parametrize(
    "part",
    [
        "<section id='discussion'><h2>t</h2><p>u</p></section>",
        "<h2 id='related-work'>t</h2><p>u</p>",
        "<h2 id='search'>t</h2><p>u</p>",
        "<div class='reply-brief'>t <p>u</p></div>",
        "<p id='social-impact'>t</p><p>u</p>",
        "<h3 id='form-of-government'>t</h3><p id=share>u</p>",
        "<section id='comments'><h2 class='sub notice-heading'>t</h2><p>u</p></section>",
    ],
)
def test_slugs_inside_articles_stay(part):
    assert one(f"<article><p>a</p>{part}<div class='x ad'>b</div><div role=navigation>c</div></article>") == "a t u"
    assert one(f"<main><p>a</p>{part}<div class='x ad'>b</div></main>") == "a t u"
