"""The corpus operators against brute force, round trips and their edge cases."""

import collections
import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("bookglass.llm")
import public_tokenizers  # noqa: E402

from bookglass.llm import bpe, chat, decontam, jaccard, linededup, quality, toxicity, warc, wrapper  # noqa: E402
from bookglass.llm.queries import VOCABULARY  # noqa: E402

SCHEMA = "doc_id long, text string, n_tokens string"
EDGE = [(1, None, "x"), (2, "", "x"), (3, "a b c", "x"), (3, "a b c", "x"), (None, "a b c", "x"), (5, "word " * 20000, "x")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x")[:3] for r in rows], SCHEMA)


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        data = f.read()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    random.seed(1)
    texts = ["".join(random.choice("aeth ns\n\té漢🎉1'-.") for _ in range(random.randint(0, 80))) for _ in range(300)] + ["ab" * 5000, " " * 3000]
    c = bpe.Codec(data, public_tokenizers.PATTERN)
    for t in texts:
        assert c.encode(t) == enc.encode_ordinary(t) and c.decode(c.encode(t)) == t.encode()
    out = bpe.encode_documents(docs(spark, EDGE), path, public_tokenizers.PATTERN, columns=("n_tokens", "decoded")).collect()
    assert len(out) == len(EDGE) and {r.decoded for r in out if r.doc_id in (1, 2)} == {""}
    assert bpe.encode_documents(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, width, percent):
    random.seed(width)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1004, "ONE two"), (1005, "one  TWO")]
    for g in range(12):
        base = [random.choice(words) for _ in range(random.choice([8, 60, 120]))]
        for k in range(12):
            own = list(base)
            for _ in range(k // 3):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append((g * 20 + k, " ".join(own)))
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    got = {r.doc: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows), width=width, percent=percent).collect()}
    assert got == {d: (len(sets[d]), top(d)) for d in ids}


def test_jaccard_chunked_blocks_lose_no_link(spark, monkeypatch):
    random.seed(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        own = list(base)
        own[random.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(own)))
    whole = {r.doc: r.component_id for r in jaccard.jaccard_components(docs(spark, rows), width=3, percent=80).collect()}
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)
    cut = {r.doc: r.component_id for r in jaccard.jaccard_components(docs(spark, rows), width=3, percent=80).collect()}
    assert whole == cut and len(set(whole.values())) < 5


def test_jaccard_edge_cases(spark):
    out = jaccard.jaccard_components(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_line_dedup_equals_brute_force(spark):
    random.seed(5)
    pool = [f"line number {i} that is certainly long enough to count" for i in range(12)] + ["short", ""]
    rows = [(d, "\n".join(random.choice(pool).upper() if random.random() < 0.3 else f"  {random.choice(pool)}\t" for _ in range(random.randint(1, 15)))) for d in range(40)] + [(100, None), (101, "")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    gone = lambda d, x: len(held[key(x)]) >= 5 and d != max(held[key(x)])
    want = {d: "\n".join(x for x in (t or "").split("\n") if not gone(d, x)) for d, t in rows}
    frame = docs(spark, rows)
    got = {r.doc_id: r.kept for r in linededup.apply_bitmaps(frame, linededup.keep_bitmaps(frame)).collect()}
    assert got == want
    e = docs(spark, EDGE)
    assert linededup.apply_bitmaps(e, linededup.keep_bitmaps(e)).count() == len(EDGE)


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (2, 0, None, "\\b\\l#<"), (3, 0, "assistant", ""), (3, None, "sys\ntem", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(t)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\nuser\n\n") and got[1].loss_sha256 == sha(said)
    assert got[2].turns_sha256 == sha("\n\\b\\l#<\n") and got[2].loss_chars == 0
    assert got[3].turns_sha256 == sha("sys\ntem\nx\nassistant\n\n") and got[3].n_turns == 2
    assert chat.digests(chat.format_conversations(t.limit(0))).count() == 0


def test_warc_round_trip_and_faults(spark):
    page = "<p>é</p>" * 300
    rows = [(1, "http://a/x y", page), (2, None, page), (3, "http://b", None), (4, "http://b", "short"), (5, "http://b", "short")]
    rows += [(100 + i, "http://c", f"<p>{i} {random.random()}</p>" * 60) for i in range(100)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(t, archive_bytes=50_000)).collect()}
    assert len(got) == len(rows)
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0
    assert all(got[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() and got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    one = warc.archive([warc.record(1, "u", b"x" * 10, None)])
    with pytest.raises(warc.WarcError):
        list(warc.frames(one[:-3]))
    raw = warc.record(1, "u", b"abc", None)
    for bad in (raw.replace(b"WARC/1.1", b"WARC/9.9"), raw[:-1], raw.replace(b"abc", b"abd")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    random.seed(2)
    terms = ["".join(random.choice("abc") for _ in range(random.randint(3, 9))) for _ in range(12)]
    a = toxicity.Automaton(terms)
    for _ in range(2000):
        w = "".join(random.choice("abc") for _ in range(random.randint(1, 10)))
        want = min(((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.allowed_edits(t)), default=None)
        assert a.find(w) == (want and (want[1], want[0]))


def test_toxicity_and_quality_learn_and_hold(spark):
    random.seed(4)
    base = [f"wort{i}" for i in range(300)]
    rows, tags = [], []
    for d in range(400):
        bad = d % 5 == 0
        w = [random.choice(base) for _ in range(40)]
        if bad:
            w[3], w[20] = "abominable", "abominable!"
        junk = d % 4 == 0
        rows.append((d, " ".join([w[0]] * 40) if junk and not bad else " ".join(w)))
        tags.append((d, int(not (junk and not bad)), int(bad)))
    frame, labels = docs(spark, [*rows, (9000, "what an abominble text"), (9001, None)]), spark.createDataFrame(tags, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(frame, toxicity.learn(frame, labels)).collect()}
    assert all(got[d].predicted == t for d, _, t in tags) and got[9000].score > got[9001].score
    m = quality.learn(frame, labels)
    q = {r.doc_id: r.predicted for r in quality.score_documents(frame, m).collect()}
    assert np.mean([q[d] == y for d, y, _ in tags]) > 0.97
    assert toxicity.score_documents(docs(spark, EDGE), toxicity.learn(frame, labels.limit(0))).count() == len(EDGE)


def test_alignment_equals_edit_distance_and_regions_are_found(spark):
    random.seed(6)
    for _ in range(150):
        p = np.array([random.choice([97, 98, 99]) for _ in range(random.randint(8, 20))], np.uint32)
        t = np.array([random.choice([97, 98, 99]) for _ in range(random.randint(0, 40))], np.uint32)
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        k = 4
        got = decontam.align(p, t, k)
        assert (got[0] if got else None) == (min(row) if min(row) <= k else None)
    item = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for jovial queens"
    near = item.replace("quick", "quikc").replace("seven", "sevn").upper()
    rows = [(1, "intro " * 30 + near + " end" * 40), (2, "nothing of the kind here " * 20), (3, None), (4, item[:40])]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "tiny")], "item_id long, text string")
    found = decontam.contaminated_regions(docs(spark, rows), bench).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)] and found[0].edits in (2, 3)
    assert decontam.contaminated_regions(docs(spark, rows), bench.limit(0)).count() == 0


def test_wrapper_keeps_the_article_alone(spark):
    page = lambda i: f"<html><head><title>t</title></head><body><nav><a href=x>m{i}</a></nav><div class='cookie-notice'>ok</div><div>Same words on each page</div><article><h1>Head {i}</h1><p>One &amp; {i}<br>two<p><b>Three   {i}</b></p><p>Share this page</article><div class=comments><p>c {i}</p></div><footer>f</footer>"
    rows = [(i, "http://h/x", page(i)) for i in range(8)] + [(50, None, None), (51, "http://g/", "<p>alone")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (wrapper.BROADCAST_BYTES, -1):
        got = {r.page_id: r.text for r in wrapper.extract_text(t, broadcast_bytes=limit).collect()}
        assert got[3].startswith("Head 3\n\nOne & 3 two\n\nThree 3") and got[50] == "" and got[51] == "alone"
