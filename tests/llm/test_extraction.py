"""Main text of pages against their known content, for several kinds of page."""

import html
import random
import re

import pytest

from strandweave.llm import extraction, markup

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def content(rng):
    return [words(rng, 6), *(words(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 7)))]


def named(rng, blocks):
    body = "".join(f"<p>{b}</p>" for b in blocks[1:])
    comments = "".join(f'<article class="comment"><p>{words(rng, 20)}</p></article>' for _ in range(rng.randint(0, 3)))
    return (
        f'<html><body><header><h1>Site</h1></header><nav><a href="/">{words(rng, 3)}</a></nav><div class="cookie-notice">We use cookies</div>'
        f'<main><article><header><h1>{blocks[0]}</h1></header>{body}<aside>{words(rng, 9)}</aside><form><p>{words(rng, 5)}</p></form></article>'
        f'<section id="comments"><h3>Comments</h3>{comments}</section></main><footer>{words(rng, 8)}</footer></body></html>'
    )


def divided(rng, blocks):
    """No element names the article; advert, sidebar and notice have classes."""
    body = "".join(f'<p class="p{i}">{b}' + "</p>" * rng.randint(0, 1) for i, b in enumerate(blocks[1:]))
    more = f'<div class="ad-box">{words(rng, 12)}</div>' if rng.random() < 0.5 else ""
    return (
        f'<body class="has-sidebar"><div id="top"><a href="/">{words(rng, 2)}</a> <a href="/x">{words(rng, 2)}</a></div><div class="wrap"><div class="title"><h1>{blocks[0]}</h1></div>'
        f'<div class="text">{more}{body}</div><div class="right-sidebar"><p>{words(rng, 15)}</p></div></div><div class="newsletter"><form>{words(rng, 9)}</form></div></body>'
    )


def bare(rng, blocks):
    """Neither classes nor names; only repetition over pages tells the lines around apart."""
    body = "".join(f"<p>{b}</p>" for b in blocks[1:])
    return f"<div>Home of things</div><div><h1>{blocks[0]}</h1>{body}<p>Printed on paper from our own trees</p></div><div>All rights reserved by the owners of this place</div>"


@pytest.mark.parametrize("kind", [named, divided, bare])
def test_hosts_of_one_kind(spark, kind):
    rng = random.Random(kind.__name__)
    pages = [content(rng) for _ in range(40)]
    rows = [(i, f"https://{kind.__name__}.example/{i}", kind(rng, b)) for i, b in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extraction.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for i, b in enumerate(pages):
        want = list(b)
        if kind is bare:
            assert got[i].split("\n")[: len(want)] == want and "Home" not in got[i] and "rights" not in got[i]
        else:
            assert got[i] == "\n".join(want), i


def test_kinds_mixed_on_one_host_and_single_pages(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        b = content(rng)
        host = "mixed.example" if i < 50 else f"alone{i}.example"
        rows.append((i, f"http://{host}/{i}", (named, divided)[i % 2](rng, b)))
        want[i] = "\n".join(b)
    got = {r["page_id"]: r["text"] for r in extraction.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: t for i, t in got.items() if t != want[i]} == {}


def test_tables_of_the_test_data(spark):
    from strandweave.llm.registry import table

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r for r in extraction.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_edges(spark):
    long_text = "word " * 400_000
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "http://a.example/", ""), (3, "no address", "just text &amp; more"), (4, "http://b.example/", f"<article><p>{long_text}</p></article>"),
        (5, "http://c.example/", deep), (6, "http://d.example/", "<article><p>cut off <a hre"), (None, "http://e.example/", '<p class="x>1 < 2 &lt;b&gt;</p>'),
        (2, "http://a.example/", ""), (7, "http://f.example/", "<nav>only</nav><footer>furniture</footer>"), (8, "http://g.example/", "<article><p>a&nbsp;b\n c<br>d</p>e<script>x</p></script></article>"),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", text int")
    got = sorted(((r["page_id"], r["text"]) for r in extraction.main_text(df).collect()), key=str)
    got = [(i, t) for i, t in got]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == "" and by[2] == "" and by[3] == "just text & more" and by[4] == long_text.strip() and by[5] == "deep"
    assert by[6] == "cut off" and by[7] == "" and by[8] == "a b c d\ne" and "1 < 2 <b>" in by[None]
    assert [t for i, t in got if i == 2] == ["", ""]
    assert extraction.main_text(df.limit(0)).collect() == []


def test_wrappers_resolve_mismatches():
    a = markup.wrapper_of(markup.parse("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>"))
    b = markup.wrapper_of(markup.parse('<div><h2>e</h2><p>f</p><ul class="x"><li>g</li></ul></div>'))
    kids = markup.merged(a, b).kids[0].kids
    assert [k.sig for k in kids] == ["(h2 p)", "ul.x"]
    assert (kids[0].n, kids[1].n) == (3, 1)  # three repetitions, one optional list
    again = markup.load(markup.dump(a))
    assert markup.dump(again) == markup.dump(a)


def test_a_wrapper_stays_bounded(monkeypatch):
    monkeypatch.setattr(markup, "MOST_NODES", 60)
    w = None
    for i in range(200):
        own = markup.wrapper_of(markup.parse(f'<article><p>t{i}</p><div class="{"abcdefghijklmnopqrst"[i % 20] * 3}">x</div></article><nav>n</nav>'))
        w = own if w is None else markup.merged(w, own)
    assert markup._size(w) <= 60
    assert markup.article('<article><p>kept</p><div class="ttt">too</div></article><nav>n</nav>', markup.plan(w)) == "kept\ntoo"
