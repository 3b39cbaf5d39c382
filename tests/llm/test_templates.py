"""What counts as a host's template where it has few pages, or copies of pages."""

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import template_extract

PAGE = "<html><body><div id=x>Site slogan</div><div id=y>Own words {0}</div></body></html>"


@pytest.mark.parametrize("most_bytes", [8 << 20, -1])
def test_few_pages_and_copies(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(template_extract, "BROADCAST_BYTES", most_bytes)
    rows = [(i, f"https://two.example/{i}", PAGE.format(i)) for i in range(2)]
    rows += [(10 + i, f"https://half.example/{i}", PAGE.format("mirrored" if i < 4 else i)) for i in range(8)]
    rows += [(20 + i, f"https://most.example/{i}", "<p>copy</p>" if i < 7 else PAGE.format(i)) for i in range(10)]
    rows += [(30 + i, f"https://only.example/{i}", PAGE.format("copied")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in template_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Own words {i}" for i in range(2)}
    want |= {10 + i: f"Own words {'mirrored' if i < 4 else i}" for i in range(8)}
    want |= {20 + i: "copy" if i < 7 else f"Own words {i}" for i in range(10)}
    want |= {30 + i: "Site slogan\nOwn words copied" for i in range(3)}
    assert got == want


LAYOUT = (
    '<html><body><div id=top><a href="/">Site</a> slogan</div>{menu}<div id=body><h1>Head {i}</h1><p>{text}</p>{more}</div>'
    "<div id=also><ul>{links}</ul></div><div id=foot>All rights {i}</div></body></html>"
)


def layout_pages(host, n, rng):
    links = lambda: "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in rng.integers(0, 99, rng.integers(4, 7)))
    page = lambda i: LAYOUT.format(i=i, menu='<div id=m><p id=n>Menu</p></div>' if i % 3 else "", text=f"Words of {i} " * int(rng.integers(3, 9)), more="<p>more</p>" * int(rng.integers(0, 3)), links=links())
    return [(f"https://{host}/{i}", page(i)) for i in range(n)]


def made_pages():
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [p for k, n in enumerate((2, 3, 9, 12)) for p in layout_pages(f"h{k}.example", n, rng)]
    rows += [rows[5]] * 3 + [("https://h3.example/none", None), ("https://h3.example/odd", "<div id=body>odd</div>"), (None, "<p>a</p>"), ("https://one.example/", "<p>b</p>")]
    return [(i, u, h) for i, (u, h) in enumerate(rows)] + [(0, *rows[0])]


def brute_classes(rows):
    """host to the sets of tokens that occur once a page, on the same pages, by vectors as dictionaries."""
    hosts = {}
    for _, u, h in rows:
        if host := template_extract.host_of(u):
            hosts.setdefault(host, set()).add(h or "")
    out = {}
    for host, pages in hosts.items():
        vectors = {}
        for k, page in enumerate(sorted(pages)):
            tokens, blocks = template_extract.parse(page)
            for t in tokens + [template_extract.text_token(b.path, b.text) for b in blocks if not b.main]:
                own = vectors.setdefault(t, {})
                own[k] = own.get(k, 0) + 1
        classes = {}
        for t, v in vectors.items():
            if set(v.values()) == {1} and len(v) >= max(2, -(-len(pages) // 2)):
                classes.setdefault(frozenset(v.items()), set()).add(t)
        out[host] = {frozenset(c) for c in classes.values() if len(c) > 1}
    return {h: c for h, c in out.items() if c}


def test_classes_against_vectors(spark):
    rows = made_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: {frozenset(c["tokens"]) for c in r["classes"]} for r in template_extract.templates(df).collect()}
    want = brute_classes(rows)
    assert got == want and len(want["h3.example"]) == 2  # the menu is a class of its own, in a slot of the other
    for r in template_extract.templates(df).where("host = 'h3.example'").collect():
        outer, inner = sorted(r["classes"], key=lambda c: -len(c["tokens"]))
        assert inner["holder"] == "/html/body" and outer["holder"] == ""
        order = [t for t in outer["tokens"] if "=" not in t]
        assert order == sorted(order, key="/html /html/body /html/body/div#top /html/body/div#body /html/body/div#body/h1 /html/body/div#also /html/body/div#also/ul /html/body/div#foot".split().index)


@pytest.mark.parametrize("most_bytes", [8 << 20, -1])
def test_slots_decide(spark, monkeypatch, most_bytes):
    """Without article elements or telling names, the template's text and lists of links go; without the template they stay."""
    monkeypatch.setattr(template_extract, "BROADCAST_BYTES", most_bytes)
    rows = made_pages()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, tokens string")
    got = template_extract.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, url, html in rows:
        if url and html and url.startswith("https://h3") and "top" in html:
            lines = by[i]["text"].split("\n")
            assert lines[0].startswith("Head ") and lines[1].startswith("Words of ") and by[i]["by_template"] == 1
            assert not any("slogan" in x or x.startswith("link ") or x == "Menu" for x in lines)
            assert "Site slogan" in template_extract.main_text(html, None)
    texts = [by[i]["text"] for i, u, h in rows if u in ("https://h3.example/odd", None, "https://one.example/") or h is None]
    assert sorted(texts) == ["", "a", "b", "odd"]


def test_doubtful_names_inside_articles(spark):
    """A name such as `related` inside an article tells boilerplate where the template has the element; a page's own element of that name stays."""
    page = '<article><h1>T {0}</h1><p>Text {0} of the page</p>{1}<div class=related><p>See {0} too</p></div></article>'
    rows = [(i, f"https://r.example/{i}", page.format(i, '<div class="discussion">We discuss 3</div>' if i == 3 else "")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in template_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T {i}\nText {i} of the page" + ("\nWe discuss 3" if i == 3 else "") for i in range(6)}


def test_a_class_out_of_order_is_not_used():
    t = template_extract.Template([("", ["/a", "/b"])], ["/b"])
    assert t.on(["/a", "/b"], []) == {"/a", "/b"} and not t.on(["/b", "/a"], []) and not t.on(["/a", "/b", "/b"], []) and not t.on(["/a"], [])


def test_repeated_rows_count_once(spark):
    """A page that is repeated very often under one page_id does not make its own text template."""
    rows = [(7, "https://rep.example/7", PAGE.format("again"))] * 30 + [(i, f"https://rep.example/{i}", PAGE.format(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert [(r["host"], r["n_pages"]) for r in template_extract.templates(df).collect()] == [("rep.example", 4)]
    got = template_extract.extract(df).collect()
    assert len(got) == 33 and {(r["page_id"], r["text"]) for r in got} == {(7, "Own words again"), *((i, f"Own words {i}") for i in range(3))}


def test_slots_decide_without_names(spark):
    """With neutral elements and no class, id or role, the slots of the hosts' templates alone give the same texts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = F.regexp_replace("html", r"<(/?)(nav|footer|aside|header|form|article|main)\b", "<$1div")
    bare = F.regexp_replace(bare, r"(?i)\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", "")
    want = {r["page_id"]: r["text"] for r in template_extract.extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in template_extract.extract(pages.withColumn("html", bare)).collect()}
    assert sum(got[k] == t for k, t in want.items()) >= 0.95 * len(want) > 0


def test_the_place_of_the_article():
    place = template_extract.article_place
    assert place({"/b/div/ul": 50, "/b/div[2]": 60, "/b/div[3]": 900, "/b/div[3]/h1": 40, "/b/div[4]": 30}) == "/b/div[3]"
    # paragraphs that are elements of the template themselves: their common holder
    assert place({"/b/div": 60, **{f"/b/div[2]/div[{k}]": 200 for k in range(2, 7)}}) == "/b/div[2]"
    assert place({"/b": 500, "/b/div": 60}) == "/b" and place({}) == ""
    rows = {"/b/div": [60, 0, 0, 0, 0], "/b/div[2]/p": [700, 0, 0, 0, 0], "/b/div[2]/h1": [30, 0, 0, 0, 0], "/b/div[3]": [400, 0, 0, 0, 0], "/b/div[4]": [900, 0, 0, 0, 900]}
    assert template_extract.article_slots(rows, 2) == ["/b/div[2]/h1", "/b/div[2]/p", "/b/div[3]"]


def test_copies_count_once_whatever_the_order(spark):
    """Rows of equal html of a host, under one id or several, and null ids, are one page of it."""
    rows = [(1, "http://h/a", "<p>x"), (1, "http://h/a", "<p>x"), (2, "http://www.h/b", "<p>x"), (None, "http://h/c", "<p>x"), (3, "http://h/d", "<p>y"), (4, None, "<p>x"), (4, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 3):
        kept = template_extract.without_copies(pages.repartition(parts)).collect()
        assert sorted(str(r["page_id"]) for r in kept) == ["1", "3", "4", "4"]  # pages without host stay as they are
