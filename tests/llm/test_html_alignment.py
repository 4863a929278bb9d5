"""Tree matching against plain recursion, wrappers that decide, and markup that is broken."""

import random

import pytest

from stagecast.llm import html_extract as html


def plain(a, b):
    """Simple tree matching as it is defined."""
    if a.label != b.label:
        return 0
    if a.boilerplate:
        return 1
    left, right = a.elements(), b.elements()
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain(x, y))
    return best[-1][-1] + 1


def random_page(rnd, depth):
    tag = rnd.choice(["div", "section", "ul"])
    inner = [random_page(rnd, depth - 1) if depth and rnd.random() < 0.5 else rnd.choice(["<p>x</p>", "<h2>x</h2>", "<nav>m</nav>"]) for _ in range(rnd.randint(0, 5))]
    return f"<{tag}>{''.join(inner)}</{tag}>"


def test_matching_is_as_large_as_it_can_be():
    rnd = random.Random(7)
    for _ in range(300):
        a, b = html.parse(random_page(rnd, 3)), html.parse(random_page(rnd, 3))
        size, pairs = html.tree_matching(a, b)
        assert size == plain(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == size


def test_many_siblings_take_little():
    a = html.parse("<div>" + "<p>a</p>" * 20_000 + "</div>")
    b = html.parse("<div><h2>b</h2>" + "<p>b</p>" * 19_000 + "<h2>c</h2></div>")
    size, pairs = html.tree_matching(a, b)
    assert size == len(pairs) == 2 + 19_000


def page(k, article_tag="div", extra=""):
    story = "".join(f"<p>Story {k} part {i}: what happened at gauge {k * 7 + i} was new.</p>" for i in range(4))
    return (
        f"<html><body><div class=x1><p>The same long introduction of the site stands on top of each and every one of its pages, "
        f"at great length and in many words, so that it holds more text than any story.</p><p>It even has a second paragraph, which "
        f"is as long, as dull and as constant as the first one, from the first page to the last.</p></div>"
        f"<{article_tag} id=post-{k} class=x2>{story}{extra}</{article_tag}></body></html>"
    )


def test_the_slots_decide_where_no_tag_does():
    """Neutral class names, no article tag, an id per page, and more template than story."""
    pages = [page(k) for k in range(5)]
    wrapper = html.induce(pages[:3])
    assert wrapper == ["html", "body", "div.x2"]
    for k, p in enumerate(pages):
        text = html.extract(p, wrapper)
        assert text.split("\n")[0].startswith(f"Story {k} part 0") and "introduction" not in text
    assert "introduction" in html.extract(pages[4], None)  # one page alone can't tell


def test_a_tag_decides_between_equals():
    pages = [page(k, "article") for k in range(3)]
    assert html.induce(pages)[-1] == "article.x2"
    assert html.induce(pages[:1] * 3) is None


@pytest.mark.parametrize("broken", [
    "<p>a<![foo[x]]>b</p>", "<![if !mso]><p>ab</p><![endif]>", "<p>a<!-- <![x]> -->b</p>", "<p>a<!bad>b</p>", "<p>a<![CDATA[x]]>b</p>",
])
def test_broken_declarations_are_comments(broken):
    assert html.extract(f"<article>{broken}</article>", None) == "ab"


@pytest.mark.parametrize("broken", ["<![", "<p>a<![x", "<", "</", "<!", "<!-", "<p", "&#xffffffff;", "<a b='", "\x00<p>\x00", "<![[[]]]>" * 50])
def test_nothing_raises(broken):
    assert isinstance(html.extract(broken, None), str) and isinstance(html.extract(f"<p>x</p>{broken}", ["html"]), str)


def test_a_page_that_breaks_stops_no_query(spark):
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(6)] + [(9, "http://h.example/9", "<![foo[x]]><p>y</p>"), (10, None, None)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 8 and got[9] == "y" and got[10] == "" and all(got[k].startswith(f"Story {k} ") for k in range(6))


def test_every_page_of_a_host_decides_its_template(spark):
    """A notice that one page in three words otherwise is template all the same, whichever pages are looked at first."""
    usual, other = "The usual notice of this site stands here. " * 12, "Today another notice stands here. " * 17
    pages = [page(k).replace("The same long introduction", (usual if k % 3 else other) + "The introduction") for k in range(400)]
    rows = [(k, f"http://h{k // 40}.example/{k}", p) for k, p in enumerate(pages)] * 2
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 800 and all(r.text.startswith(f"Story {r.page_id} part 0") and "notice" not in r.text for r in got)
    copies = spark.createDataFrame([("h", pages[1])] * 5 + [(None, pages[1]), ("e", ""), ("n", None)], "host string, html string")
    assert {r.wrapper for r in html.wrappers(copies.where("host IS NOT NULL")).collect()} == {"null"}


def test_children_are_paired_once(monkeypatch):
    """Pairs of two nodes' children are found once and kept for the way back, unless there are very many."""
    page = "<div>" + "".join(f"<section><p>a{i}<b>x</b></p><p>c<i>y</i></p></section>" for i in range(6)) + "</div>"
    a, b = html.parse(page), html.parse(page.replace("<section>", "<section><h2>t<u>z</u></h2>", 3))
    paired, calls = html._children_matched, []
    monkeypatch.setattr(html, "_children_matched", lambda x, y, *rest: calls.append((id(x), id(y))) or paired(x, y, *rest))
    kept = html.tree_matching(a, b)
    assert len(calls) == len(set(calls))
    monkeypatch.setattr(html, "KEPT_PAIRS", 0)
    assert html.tree_matching(a, b)[0] == kept[0] and set(html.tree_matching(a, b)[1]) == set(kept[1])
