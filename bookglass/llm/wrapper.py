"""HTML extraction by wrapper induction: page trees of a host are aligned by simple tree matching into one template."""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookglass.llm.common import partitions, prepare, written

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no running text of the page: never shown, or a control.
NEVER = frozenset("head button select option input script style textarea title noscript template iframe svg math object embed canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
LISTS = frozenset("ul ol dl table select".split())
#: Names that speak for or against an element; they break ties inside the content and stand in where a page has no template.
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside form dialog menu".split())
CLUTTER = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|comment|comments|disqus|respond|replies|cookie|cookies|consent|notice|notices|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|share|sharing|social|related|recommended|recommendations|widget|footer|masthead|topbar|toolbar|search|login|toc|tags|skip)(?:$|[\s_-])", re.I)
OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: Distinct pages before a template counts; share of them that a constant slot's one text must be on.
LEAST_PAGES, CONSTANT_SHARE = 4, 0.9
#: Share of a slot's text in links that makes it a menu; share of a node's varying text that a child needs to be the way to the content.
LINKY, DOMINANT = 0.5, 0.6
#: A page's text is this many parts, so slots add up in whole numbers.
PARTS = 1_000_000
#: Levels of a template, slots of one page's parent, slots of a template's parent; deeper and further ones are folded together.
LEVELS, WIDE, WIDEST = 64, 64, 256
#: Bytes of all templates that may be broadcast; pages of a host in one piece where they aren't.
BROADCAST_BYTES, HOST_PAGES = 16 * 1024 * 1024, 200_000
#: Hosts whose templates a worker keeps; parts a host's templates are merged in first; pages whose digests a task remembers.
HOSTS, SALTS, SEEN = 500, 32, 200_000


class Element:
    """A node of a page: its tag, label (tag and class), whether its name speaks against it, its children (elements and texts)."""

    __slots__ = ("tag", "label", "clutter", "kids", "slot")

    def __init__(self, tag: str, label: str, clutter: bool) -> None:
        self.tag, self.label, self.clutter, self.kids, self.slot = tag, label, clutter, [], None


def _element(tag: str, attributes: str) -> Element:
    names = [" ".join(filter(None, x.groups()[1:])) for x in ATTRIBUTE.finditer(attributes)] if "=" in attributes else []
    mark = re.sub(r"\d+", "", " ".join(names).lower()).strip()
    against = tag in ASIDE or bool(mark and tag not in ("html", "body", "article", "main") and CLUTTER.search(mark))
    return Element(tag, f"{tag}.{mark}" if mark and tag not in INLINE else tag, against)


def tree(page: str) -> Element:
    """The element tree; unclosed elements end where HTML's rules or their parents end them; unknown end tags are passed over.

    One pass in linear time: a quotation mark in a tag that is never closed is taken as a plain character, as are those
    before it, and what follows the last ">" is text.
    """
    top = Element("#root", "#root", False)
    stack, at, open_tags = [top], 0, {}
    last, plain = page.rfind(">"), -1

    def close(i: int) -> None:
        for e in stack[i:]:
            open_tags[e.tag] -= 1
        del stack[i:]

    while m := OPENING.search(page, at):
        begin, end = m.start(), m.end()
        if begin > last and not m.group(1):
            break
        if begin > at:
            stack[-1].kids.append(page[at:begin])
        if m.group(1):
            end = page.find("-->", end)
            at = end + 3 if end >= 0 else len(page)
            continue
        if m.group(2):
            at = page.find(">", end) + 1
            continue
        inside = INSIDE.match(page, end) if end > plain else None
        stop = inside.end() if inside else page.find(">", end)
        if stop >= len(page) or page[stop] != ">":
            plain, stop = stop, page.find(">", end)
        at = stop + 1
        tag = m.group(4).lower()
        if m.group(3):
            if open_tags.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in SIBLINGS and any(map(open_tags.get, SIBLINGS[tag])):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                elif stack[i].tag in LISTS or stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        attributes = page[end:stop]
        e = _element(tag, attributes)
        stack[-1].kids.append(e)
        if tag in RAW:
            found = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = (page.find(">", found.start()) + 1 or len(page)) if found else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(e)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return top


class Slot:
    """A node of a template: pages that have it and those with text in it, the one text it has had (or None: several), the
    parts of the pages' texts that are its own and those of them in links, and whether its name speaks against it."""

    __slots__ = ("label", "pages", "texts", "text", "parts", "links", "clutter", "kids", "weight", "content")

    def __init__(self, label: str, clutter: bool = False) -> None:
        self.label, self.clutter, self.pages, self.texts, self.text, self.parts, self.links, self.kids = label, clutter, 1, 0, "", 0, 0, []
        self.weight, self.content = 0, False


def _names(e: Element) -> list[str]:
    """A label per child element that is a block: runs of one label are one slot; parents of very many runs have a slot
    per label, per tag, or one for all."""
    labels = [k.label for k in e.kids if not isinstance(k, str) and k.tag not in INLINE and k.tag not in NEVER]
    if len(labels) <= WIDE or sum(a != b for a, b in zip(labels, labels[1:])) < WIDE:
        return labels
    if len(set(labels)) <= WIDE:
        return [f"*{x}" for x in labels]
    tags = [x.partition(".")[0] for x in labels]
    return [f"*{x}" for x in tags] if len(set(tags)) <= WIDE else ["*"] * len(tags)


def skeleton(page: Element) -> Slot:
    """A page's tree of block elements, without what is never shown, as a template of one page. Elements know their slot."""
    top = Slot(page.label)
    told: dict[Slot, list] = {}
    todo = [(page, top, False, 0)]
    while todo:
        e, s, link, level = todo.pop()
        e.slot = s
        labels, new = iter(_names(e) if level < LEVELS else ()), []
        by_label = {}
        for k in e.kids:
            if isinstance(k, str):
                if text := " ".join(k.split()):
                    told.setdefault(s, []).append((text, len(text) * link))
            elif k.tag in INLINE:
                new.append((k, s, link or k.tag == "a", level))
            elif k.tag not in NEVER:
                label = next(labels, None)
                if label is None:  # too deep for slots of its own
                    new.append((k, s, link, level))
                    continue
                shared = by_label.get(label) if label.startswith("*") else s.kids[-1] if s.kids and s.kids[-1].label == label else None
                if shared is None and len(s.kids) >= WIDEST:
                    shared = s.kids[-1]
                elif shared is None:
                    shared = by_label[label] = Slot(label, k.clutter)
                    s.kids.append(shared)
                new.append((k, shared, link, level + 1))
        todo += reversed(new)
    total = sum(len(t) for x in told.values() for t, _ in x) or 1
    for s, x in told.items():
        chars = sum(len(t) for t, _ in x)
        s.text, s.texts = xxhash.xxh3_64_hexdigest(" ".join(t for t, _ in x)), 1
        s.parts, s.links = PARTS * chars // total, PARTS * sum(n for _, n in x) // total
    return top


def match(a: list[Slot], b: list[Slot], known: dict | None = None) -> list[tuple[int | None, int | None]]:
    """Alignment of two lists of siblings by simple tree matching: pairs of places, None where one has no counterpart."""
    known = {} if known is None else known
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    weight = [[0] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            if a[i].label == b[j].label:
                weight[i][j] = 1 + size_of_match(a[i], b[j], known)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
    out, i, j = [], n, m
    while i or j:
        if i and j and weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and best[i][j] == best[i - 1][j]:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def size_of_match(x: Slot, y: Slot, known: dict) -> int:
    """Pairs of nodes below x and y in the largest matching that keeps order and parents; each pair of nodes is met once."""
    if not x.kids or not y.kids:
        return 0
    key = (id(x), id(y))
    if key not in known:
        row = [0] * (len(y.kids) + 1)
        for u in x.kids:
            new = [0]
            for j, v in enumerate(y.kids):
                new.append(max(row[j + 1], new[j], row[j] + (1 + size_of_match(u, v, known) if u.label == v.label else 0)))
            row = new
        known[key] = row[-1]
    return known[key]


def absorb(t: Slot, s: Slot, known: dict | None = None) -> None:
    """Add the counts of an aligned tree to a template; nodes without a counterpart become optional nodes in their place.
    Of a parent with over WIDEST slots the rarest go: a text on a few pages of a hundred can't be constant."""
    if t.text != s.text:
        t.text = None if t.text and s.text or t.text is None or s.text is None else t.text or s.text
    t.pages, t.texts, t.parts, t.links = t.pages + s.pages, t.texts + s.texts, t.parts + s.parts, t.links + s.links
    if [k.label for k in t.kids] == [k.label for k in s.kids]:
        for x, y in zip(t.kids, s.kids, strict=True):
            absorb(x, y)
        return
    known = {} if known is None else known
    merged = []
    for i, j in match(t.kids, s.kids, known):
        if i is not None and j is not None:
            absorb(t.kids[i], s.kids[j], known)
        merged.append(t.kids[i] if i is not None else s.kids[j])
    if len(merged) > WIDEST:
        kept = set(map(id, sorted(merged, key=lambda k: (-k.pages, k.label))[:WIDEST]))
        merged = [k for k in merged if id(k) in kept]
    t.kids = merged


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
    return m.group(1).lower() if m else ""


def domain_of(host: str) -> str:
    """The host's last two labels, after a dot, so that no host is taken for it."""
    return "." + ".".join(host.split(".")[-2:])


def dump(s: Slot) -> bytes:
    flat = lambda s: (s.label, s.clutter, s.pages, s.texts, s.text, s.parts, s.links, [flat(k) for k in s.kids])
    return pickle.dumps(flat(s), protocol=5)


def load(data: bytes) -> Slot:
    def deep(x: tuple) -> Slot:
        s = Slot(x[0], x[1])
        s.pages, s.texts, s.text, s.parts, s.links = x[2:7]
        s.kids = [deep(k) for k in x[7]]
        return s

    return deep(pickle.loads(data))


def _linky(s: Slot) -> bool:
    return s.links > LINKY * s.parts > 0


def ready(t: Slot) -> Slot:
    """The template with each slot's weight, the parts of varying text in and below it, and the way to its content marked:
    from the root down to the child that has most of the varying text, as long as that text is in blocks below the child."""
    least = max(LEAST_PAGES, CONSTANT_SHARE * t.pages)

    def weigh(s: Slot) -> int:
        fixed = bool(s.text) and s.texts >= least
        s.weight = (0 if fixed or _linky(s) else s.parts) + sum(map(weigh, s.kids))
        s.text = "fixed" if fixed else ""
        return s.weight

    weigh(t)
    at = t
    while at.kids:
        k = max(at.kids, key=lambda k: k.weight)
        own = k.weight - sum(x.weight for x in k.kids)
        if k.weight < DOMINANT * at.weight or 2 * own > k.weight or not k.weight:
            break
        at.content = True
        at = k
    at.content = True
    return t


def decide(top: Slot, template: Slot) -> set[int]:
    """Ids of the slots of a page that hold content, by its host's template (see extract); none if the page lacks the way there."""
    kept: set[int] = set()
    own, root = top, template
    while (below := next((k for k in root.kids if k.content), None)) is not None:
        own = next((x for x, y in _pairs(own, root) if y is below), None)
        if own is None:
            return kept
        root = below
    todo: list[tuple[Slot, Slot | None]] = [(own, root)]
    while todo:
        own, t = todo.pop()
        if own.clutter and t is not root and not (t is not None and 2 * t.weight >= root.weight > 0):
            continue
        if not (t is not None and t.text) and not _linky(t or own):
            kept.add(id(own))
        todo += _pairs(own, t) if t is not None else [(k, None) for k in own.kids]
    return kept


def _pairs(own: Slot, t: Slot) -> list[tuple[Slot, Slot | None]]:
    if [k.label for k in own.kids] == [k.label for k in t.kids]:
        return list(zip(own.kids, t.kids, strict=True))
    return [(own.kids[i], t.kids[j] if j is not None else None) for i, j in match(own.kids, t.kids) if i is not None]


def extract(page: str, template: Slot | None) -> str:
    """The main text: blocks in page order, joined by an empty line.

    What is never shown goes first (NEVER). With a template (made ready, of LEAST_PAGES distinct pages at least), the
    aligned slots decide: those with one text on CONSTANT_SHARE of the pages and those made of links are template; of
    the rest, the content lies where most of the varying text is, as all pages of the host have it on average. Names
    (ASIDE, CLUTTER) only decide on slots inside the content, and not against one that holds half of it. A page without
    the way to the content, or with nothing in it, and one without a template goes by names alone: the article or main
    element, if there is one, less what names speak against and what is made of links; without links if nothing stays.
    """
    top = tree(page)
    own = skeleton(top)
    if template is not None and (kept := decide(own, template)) and (text := _text([top], lambda e: id(e.slot) in kept, lambda e: e.clutter and e.tag in INLINE)):
        return text
    roots = _mains(top) or [top]
    return _text(roots, lambda e: not _linky(e.slot), lambda e: e.clutter) or _text(roots, lambda e: True, lambda e: e.clutter)


def _mains(e: Element) -> list[Element]:
    out = []
    todo = [e]
    while todo:
        x = todo.pop()
        if x.tag in MAIN and not x.clutter:
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.clutter and k.tag not in NEVER]
    return out


def _text(roots: list[Element], keep, skip) -> str:
    """The blocks below some elements whose own text is kept, without the elements to skip."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append(text)

    for root in roots:
        todo = [(iter(root.kids), keep(root), True)]
        while todo:
            kids, kept, block = todo[-1]
            for k in kids:
                if isinstance(k, str):
                    if kept:
                        part.append(k)
                elif k.tag in INLINE:
                    if k.tag == "br":
                        part.append(" ")
                    if k.kids and not skip(k):
                        todo.append((iter(k.kids), kept, False))
                        break
                else:
                    close()
                    if k.tag not in NEVER and not skip(k):
                        todo.append((iter(k.kids), keep(k), True))
                        break
            else:
                if block:
                    close()
                todo.pop()
    return "\n\n".join(out)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page digest, skeleton) of the pages; copies within a task are left out as far as SEEN reaches."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        hosts, digests, trees = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if page:
                host, data = host_of(url), dump(skeleton(tree(page)))
                digest = xxhash.xxh3_128_digest(data)
                if (host, digest) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((host, digest))
                    hosts.append(host)
                    digests.append(digest)
                    trees.append(zlib.compress(data, 1))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(trees, pa.binary())], names=["host", "digest", "page"])


def _template(host: str, t: Slot) -> pa.RecordBatch:
    data = dump(t)
    return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([xxhash.xxh3_64_intdigest(data) % SALTS], pa.int32()), pa.array([t.pages], pa.int64()), pa.array([data], pa.binary())], names=["host", "salt", "pages", "template"])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A template of each host of a partition sorted by host and digest, from its distinct pages."""
    host, digest, template = None, None, None
    for batch in batches:
        for h, d, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if h == host and d == digest:
                continue
            s = load(zlib.decompress(page))
            if h != host:
                if template is not None:
                    yield _template(host, template)
                host, template = h, s
            else:
                absorb(template, s)
            digest = d
    if template is not None:
        yield _template(host, template)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of a partition sorted by host and part, merged one by one as they come, so a host with many parts is never held whole."""
    current, template = None, None
    for batch in batches:
        for host, part, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if template is not None and (host, part) == current:
                absorb(template, load(data))
                continue
            if template is not None:
                yield _template(current[0], template)
            current, template = (host, part), load(data)
    if template is not None:
        yield _template(current[0], template)


TEMPLATE = "host string, salt int, pages long, template binary"


def _merged(parts: DataFrame) -> DataFrame:
    """One template per host from its parts, in two steps: by (host, salt), then by host."""
    n = partitions(parts.sparkSession)
    for part in ("salt", F.lit(0)):
        p = parts.select("host", (F.col(part) if isinstance(part, str) else part).alias("part"), "template")
        parts = p.repartition(n, "host", "part").sortWithinPartitions("host", "part", "template").mapInArrow(_merge, TEMPLATE)
    return parts


def induce_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, template) from all distinct pages of each host and, under its name after a dot, of each domain: pages
    of one skeleton (blocks and their texts) are copies and count once. Skeletons, not pages, are dealt by digest and
    aligned; parts are merged by (host, salt) and by host, so a host with a third of all pages is shared out. A domain's
    template is merged from those of its hosts. No pages give no rows."""
    spark = pages.sparkSession
    prepare(spark)
    n = partitions(spark)
    every = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(_skeletons, "host string, digest binary, page binary")
    parts = every.repartition(n, "host", "digest").sortWithinPartitions("host", "digest").mapInArrow(_induce, TEMPLATE)
    hosts = written(_merged(parts), "host-templates")
    domain = F.concat(F.lit("."), F.substring_index("host", ".", -2))
    domains = _merged(hosts.select(domain.alias("host"), "salt", "template"))
    return hosts.unionByName(domains).select("host", "pages", "template")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES, use_templates: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Templates are induced from all pages first: a page goes by its host's, or by its domain's where the host has fewer
    than LEAST_PAGES distinct pages. They are broadcast if they all take at most broadcast_bytes; else pages are dealt by
    host, in pieces of about HOST_PAGES pages, and each piece meets its host's template once, ahead of its pages.
    Null or empty html: an empty text. A null url, or one without a host, belongs to the host "". Repeated rows and null
    ids get a row each. Other columns are not read, so their names may be any. No rows give none. With use_templates off
    every page goes by names alone, to measure what templates are worth.
    """
    spark = pages.sparkSession
    prepare(spark)
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))

    def batch_of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    if not use_templates:
        return rows.mapInArrow(lambda it: (batch_of(b, [extract(p, None) if p else "" for p in b.column(2).to_pylist()]) for b in it), schema)
    templates = written(induce_templates(pages, url_col=url_col, html_col=html_col), "templates").where(F.col("pages") >= LEAST_PAGES)
    size = templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in templates.toLocalIterator()})

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[str, Slot | None] = {}
            for batch in batches:
                texts = []
                for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    host = host_of(url)
                    if host not in loaded:
                        if len(loaded) >= HOSTS:
                            loaded.clear()
                        data = sent.value.get(host) or sent.value.get(domain_of(host))
                        loaded[host] = ready(load(data)) if data else None
                    texts.append(extract(page, loaded[host]) if page else "")
                yield batch_of(batch, texts)

        return rows.mapInArrow(task, schema)

    # Pages and templates meet by (key, piece): the key is the host if it has a template, else the domain.
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    domain = F.concat(F.lit("."), F.substring_index("__key", ".", -2))
    own = templates.select(F.col("host").alias("__key"), F.lit(True).alias("__own"))
    keyed = rows.withColumn("__key", host).join(own, "__key", "left").withColumn("__key", F.when(F.col("__own"), F.col("__key")).otherwise(domain))
    many = F.ceil(F.col("pages") / HOST_PAGES).cast("int")
    hot = templates.where(F.col("pages") > HOST_PAGES).select(F.col("host").alias("__key"), many.alias("__many"))
    dealt = keyed.join(hot, "__key", "left").select(id_col, url_col, "__html", F.lit(None).cast("binary").alias("__template"), "__key", F.pmod(F.xxhash64("__html"), F.coalesce("__many", F.lit(1))).cast("int").alias("__piece"))
    none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in (id_col, url_col)]
    ahead = templates.select(*none, F.lit(None).cast("string").alias("__html"), F.col("template").alias("__template"), F.col("host").alias("__key"), F.explode(F.sequence(F.lit(0), many - 1)).alias("__piece"))
    both = dealt.unionByName(ahead).repartition(partitions(spark), "__key", "__piece").sortWithinPartitions("__key", "__piece", F.col("__template").desc_nulls_last())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, template = None, None
        for batch in batches:
            texts, kept = [], []
            for n, (page, data, key) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                if data is not None:
                    at, template = key, ready(load(data))
                else:
                    kept.append(n)
                    texts.append(extract(page, template if key == at else None) if page else "")
            yield batch_of(batch.take(pa.array(kept, pa.int32())), texts)

    return both.mapInArrow(meet, schema)
