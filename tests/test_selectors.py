"""Selectors of one streaming pass against a small document tree; links and addresses."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from larkspan.functions import selectors, text
from larkspan.functions.selectors import Field, compiled, taken


class Node:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


def tree(rng, parent, depth, out):
    for _ in range(rng.randint(0, 3)):
        if rng.random() < 0.3:
            parent.children.append(rng.choice(["x", " y ", "&amp;", "é"]))
            continue
        a = {k: v for k, v in (("class", rng.choice(["a", "b", "a b", "ab"])), ("id", rng.choice("pq")), ("data-k", rng.choice(["one", "one-two", "two one"]))) if rng.random() < 0.4}
        node = Node(rng.choice(["div", "span", "b"]), a, parent)
        parent.children.append(node)
        out.append(node)
        if depth < 4:
            tree(rng, node, depth + 1, out)


def written(node):
    if isinstance(node, str):
        return node
    return f"<{node.tag}{''.join(f' {k}={chr(39)}{v}{chr(39)}' for k, v in node.attributes.items())}>{''.join(map(written, node.children))}</{node.tag}>"


def said(node):
    return (node.replace("&amp;", "&") if isinstance(node, str) else "".join(map(said, node.children)))


def fits(node, steps):
    step = steps[-1]
    if not isinstance(node, Node) or node.parent is None or not step.fits(node.tag, node.attributes):
        return False
    if len(steps) == 1:
        return True
    brothers = [c for c in node.parent.children if isinstance(c, Node)]
    earlier = brothers[: brothers.index(node)]
    above, at = [], node.parent
    while at.parent is not None:
        above.append(at)
        at = at.parent
    near = {" ": above, ">": above[:1] if node.parent.parent is not None else [], "+": earlier[-1:], "~": earlier}[step.after]
    return any(fits(n, steps[:-1]) for n in near)


SELECTORS = ["div", ".a", "#p", "div .a", "div > span", "span + b", "b ~ .b", "[data-k]", "[data-k=one]", "[data-k~='one']", '[data-k|="one"]', "[data-k^=one] > *", "[data-k$=two]", "[data-k*='e-t']", "div.a.b, b#q", "div div > .b span", "div > div + span b"]


def test_against_a_tree():
    rng = random.Random(1)
    for _ in range(150):
        root, nodes = Node("", {}, None), []
        tree(rng, root, 0, nodes)
        page = "".join(map(written, root.children))
        got = taken(page, [Field(s, all=True) for s in SELECTORS] + [Field(s) for s in SELECTORS] + [Field(s, "id", True) for s in SELECTORS])
        for i, s in enumerate(SELECTORS):
            match = [n for n in nodes if any(fits(n, steps) for steps in compiled(s))]
            assert got[i] == [said(n).strip() for n in match], (s, page)
            assert got[i + len(SELECTORS)] == (said(match[0]).strip() if match else None)
            assert got[i + 2 * len(SELECTORS)] == [n.attributes["id"] for n in match if "id" in n.attributes]


def test_untidy_pages():
    page = "<ul><li>one<li class=x>two<ul><li>in</ul><li>three</ul><p>a<div>b</div><table><tr><td>1<td>2<tr><td>3</table><img class=x src=i.png><br>tail</zz>"
    got = taken(page, [Field("ul > li", all=True), Field("p"), Field("td", all=True), Field("img.x", "src"), Field("li.x"), Field("none"), Field("div", all=True), Field(("li", "class", "x"))])
    assert got == [["one", "twoin", "in", "three"], "a", ["1", "2", "3"], "i.png", "twoin", None, ["b"], "twoin"]
    assert taken("", [Field("a"), Field("a", all=True)]) == [None, []] and taken("<a>unclosed <b>x", [Field("a")]) == ["unclosed x"]


@pytest.mark.parametrize("bad", ["", " ", ">a", "a >", "a,,b", "a:hover", "[x"])
def test_not_a_selector(bad):
    with pytest.raises(ValueError):
        compiled(bad)


def test_page_fields(spark):
    df = spark.createDataFrame([(1, "<h1>T</h1><a href=/x>l</a><a href='/y'>m</a>"), (2, None), (3, "no element")], "i int, html string")
    out = df.select("i", selectors.page_fields("html", {"title": Field("h1"), "links": Field("a", "href", True)}).alias("f")).orderBy("i").collect()
    assert [(r.f.title, r.f.links) for r in out] == [("T", ["/x", "/y"]), (None, None), (None, [])]


def test_links_in_any_quotes(spark):
    page = """<a href="/v/1">a</a><a class=z href='/v/2'>b</a><A HREF=/v/3>c</a><a href = "/v/1">d</a><a data-href="/v/9" href="/other">e</a>"""
    df = spark.createDataFrame([(page,), ("<a href='/w/5'>",)], "html string")
    assert [sorted(r[0]) for r in df.select(text.links("html", r"/v/\d+", r"/w/\d+")).collect()] == [["/v/1", "/v/2", "/v/3"], ["/w/5"]]


def test_relative_addresses(spark):
    base = "http://a.b/c/d/e?q=1"
    urls = ["../x", "./x", "x", "/x/../y", "//h/p?z", "http://z/../k#f", "", "?n=2", "../../..", "../..", ".", "x/./y/..", "/", "../../../../x", "#top"]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.clean_url("u", base).alias("v")).collect()
    for r in found:
        expected = urljoin(base, r.u).split("#")[0].split("?")[0]
        assert r.v == expected, (r.u, r.v, expected)
    assert spark.createDataFrame([("x",)], "u string").select(text.clean_url("u", "http://a.b")).first()[0] == "http://a.b/x"
