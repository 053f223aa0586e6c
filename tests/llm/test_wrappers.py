"""Main text of hosts with mixed templates."""

import json
import random

import pytest

from xrdlake.llm import wrappers


def texts(spark, pages):
    rows = [(i, f"http://h.i/{i}", p) for i, p in enumerate(pages)]
    return [r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_pages_without_a_main_element_beside_one_with(spark):
    pages = ["<body><main><p>In main</p></main><div><p>Beside</p></div></body>"] + [f"<body><div class=menu>Menu</div><div class=box><p>Text {i}</p><p>More {i}</p></div></body>" for i in range(4)]
    assert texts(spark, [*pages, "<body><article> </article><div class=box><p>Last</p></div></body>"]) == ["In main", *(f"Text {i}\nMore {i}" for i in range(4)), "Last"]


@pytest.mark.parametrize(("container", "kept"), [
    ("div class=content-with-sidebar", True), ("div class='page sidebar-right'", True), ("div id=wrap-header-side", True),
    ("div class=sidebar", False), ("div class=comment-list", False), ("nav", False), ("div class='related-posts sidebar-right'", False)])
def test_articles_in_named_containers(container, kept):
    page = f"<{container}><article>A</article><p>B</p></{container.split()[0]}>"
    aside = {e[5]: e[2] for e in wrappers.Reader().walk(page) if e[0] == "text"}
    assert aside == {"A": not kept, "B": True}


def test_slots_are_nodes_of_the_expression(spark):
    """The same line on every page is left out even where texts with the same tags around them vary: the two are different nodes."""
    pages = [f"<body><div>Same on all</div><h2>Title {i}</h2><div>Text {i}</div>{'<hr><h3>Extra</h3>' * (i == 2)}</body>" for i in range(5)]
    assert texts(spark, pages) == [f"Title {i}\nText {i}" + "\nExtra" * (i == 2) for i in range(5)]


def test_expressions_hold_their_pages():
    r = random.Random(5)

    def part(depth):
        return "".join(f"<{t} class=c{r.randrange(3)}>{'x' * r.randrange(2)}{part(depth - 1) if depth else 'y'}</{t}>" + "z" * r.randrange(2) for t in r.choices(("div", "p", "b", "ul", "li"), k=r.randrange(5)))

    for _ in range(60):
        pages = [part(3) for _ in range(6)]
        e = wrappers.Expression(wrappers.join_streams(json.dumps(wrappers.stream(p)[0]) for p in pages))
        assert all(x[1] is None or x[1] > 0 for p in pages for x in e.match(p) if x[0] == "text")
