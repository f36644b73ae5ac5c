"""Copies of one page don't make its article the host's template."""

from bookglass.llm import wrapper

HEAD = "<div class=top>Same words on each page</div>"


def extracted(spark, pages):
    t = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    rows = [wrapper.extract_text(t, broadcast_bytes=b).collect() for b in (wrapper.BROADCAST_BYTES, -1)]
    one, two = ({r.page_id: r.text for r in x} for x in rows)
    assert one == two
    return one


def test_copies_keep_slots_of_their_own(spark):
    copy = f"<body>{HEAD}<p>Text of the copied page</p><blockquote>Quoted</blockquote><table><tr><td>1</td></tr></table></body>"
    others = [f"<body>{HEAD}<p>Other {i}</p></body>" for i in range(5)]
    got = extracted(spark, [copy] * 5 + others)
    assert [got[i] for i in range(5)] == ["Text of the copied page\n\nQuoted\n\n1"] * 5
    assert [got[5 + i] for i in range(5)] == [f"Other {i}" for i in range(5)]


def test_copies_that_differ_in_one_slot_keep_the_article(spark):
    near = [f"<body>{HEAD}<h4>May {i}</h4><section>The article</section><blockquote>Quoted</blockquote></body>" for i in range(5)]
    others = [f"<body>{HEAD}<p>Other {i}</p></body>" for i in range(4)]
    got = extracted(spark, near + others)
    assert [got[i] for i in range(5)] == [f"May {i}\n\nThe article\n\nQuoted" for i in range(5)]
    assert got[5] == "Other 0"


def test_a_text_that_one_page_has_is_not_the_templates(spark):
    pages = [f"<body>{HEAD}<section>{'Alone' if i == 2 else ''}<p>Body {i}</p></section></body>" for i in range(6)]
    got = extracted(spark, pages)
    assert got[2] == "Alone\n\nBody 2" and got[3] == "Body 3"
