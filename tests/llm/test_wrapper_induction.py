"""Templates decide the text; matching equals brute force; deep, broken and odd pages."""

import random
import time

import pytest

from bookglass.llm import wrapper as w

SHELL = "<div class=ka><a href=x>m{i}</a> <a href=y>n{i}</a></div><div class=kb>Buy {i} now</div><div class=kc><h2>Title {i}</h2><p>{body}</p><div class=ke>Always the same line</div></div><div class=kd>Imprint {i}</div>"
SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def body(i):
    random.seed(i)
    return " ".join(f"w{random.randrange(500)}" for _ in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def test_names_that_say_nothing(spark):
    rows = [(i, "http://h.a.org/1", SHELL.format(i=i, body=body(i))) for i in range(12)]
    rows += [(100, "http://few.a.org/", SHELL.format(i=100, body=body(100)))]  # one page of its host: by its domain
    t = frame(spark, rows)
    want = {i: f"Title {i}\n\n{body(i)}" for i, _, _ in rows}
    for limit in (w.BROADCAST_BYTES, -1):
        assert {r.page_id: r.text for r in w.extract_text(t, broadcast_bytes=limit).collect()} == want
    plain = {r.page_id: r.text for r in w.extract_text(t, use_templates=False).collect()}
    assert not any(plain[i] == want[i] for i in want)


def test_templates_overrule_a_misleading_name(spark):
    page = lambda i: f"<div class=top>Same on each</div><div class='widget'><p>{body(i)}</p><div class=comments><p>c{i}</p></div></div><article>ad {i}</article>"
    got = {r.page_id: r.text for r in w.extract_text(frame(spark, [(i, "http://h/", page(i)) for i in range(8)])).collect()}
    assert got == {i: body(i) for i in range(8)}


def slots(rng, depth=0):
    s = w.Slot(rng.choice("ab"))
    if depth < 3:
        s.kids = [slots(rng, depth + 1) for _ in range(rng.randrange(3))]
    return s


def brute(a, b):
    """Most pairs of nodes of two forests that keep order, parents and labels."""
    if not a or not b:
        return 0
    best = max(brute(a[1:], b), brute(a, b[1:]))
    return max(best, 1 + brute(a[0].kids, b[0].kids) + brute(a[1:], b[1:])) if a[0].label == b[0].label else best


def test_matching_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        x, y = slots(rng), slots(rng)
        assert w.size_of_match(x, y, {}) == brute(x.kids, y.kids)
        pairs = w.match(x.kids, y.kids)
        assert sum(1 + brute(x.kids[i].kids, y.kids[j].kids) for i, j in pairs if i is not None and j is not None) == brute(x.kids, y.kids)
        n = x.pages + y.pages
        w.absorb(x, y)
        assert x.pages == n


@pytest.mark.parametrize("page", ["<div>" * 5000 + "deep" + "</div>" * 5000, "<b><i>" * 5000 + "deep", "<ul><li>" * 5000 + "deep"])
def test_deep_pages(page):
    for _ in range(2):
        t = w.skeleton(w.tree(page))
        w.absorb(t, w.skeleton(w.tree(page.replace("deep", "deeper"))))
        w.load(w.dump(t))
    assert w.extract(page, None) == "deep"


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '><a \"", "<!x ", "<!-- ", "</x>", "<script>", "<p><b>", "<li><b>x</li>", "<q<q ", "<h1>x</h1><h2>y</h2>", "<div class=a{i}><p>x</p></div>"])
def test_a_megabyte_of_broken_markup_takes_linear_time(piece):
    page = "<p>start</p>" + "".join(piece.replace("{i}", chr(97 + i % 26) * (i % 7)) for i in range(1_000_000 // len(piece)))
    began = time.time()
    t = w.skeleton(w.tree(page))
    w.absorb(t, w.skeleton(w.tree(page + "<p>end")))
    assert w.extract(page, None).startswith("start")
    assert time.time() - began < 30


def test_edge_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 50_000
    rows = [(1, None, None), (2, "", ""), (3, "no host", "<p>x"), (3, "no host", "<p>x"), (None, "http://h/", "a<br>b"), (5, "http://h/", long), (6, "http://h/", "&lt;p&gt; <span class=ad>no</span>")]
    t = frame(spark, rows)
    for limit in (w.BROADCAST_BYTES, -1):
        got = sorted((r.page_id or 0, r.text, r.n_chars) for r in w.extract_text(t, broadcast_bytes=limit).collect())
        assert [x[1] for x in got[:5]] == ["a b", "", "", "x", "x"] and got[6][1] == "<p>" and all(n == len(x) for _, x, n in got)
        assert got[5][1] == "\n\n".join(["word & word"] * 50_000)
        assert w.extract_text(t.limit(0), broadcast_bytes=limit).count() == 0
