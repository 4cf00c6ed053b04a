"""Main text of web pages by two-pass block rules (op8).

Pass one looks at each block alone: where it stands (menus, headers, footers, sidebars, forms, notices,
adverts and comments are out), its link density, its length and its density of stop words. Pass two lets
short undecided blocks inherit the label of the nearest decided neighbours; a heading looks ahead first.
If a page has an article or main element with text, that decides: all its blocks but the elements named above are
kept, blocks outside it are out, and the passes are not needed. If no block is sure, undecided ones are kept.

Null or empty html: empty text. Null page_id or url: kept as null. Repeated rows get equal results; extra columns are ignored; an empty
table gives an empty table. A break inside a block counts as white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, text_slices

#: Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
OUT = set("nav footer aside form script style noscript template select button iframe svg canvas object head textarea dialog menu".split())
CORE = {"article", "main"}
CONTAINERS = set("div section article main body td th li ul ol table blockquote aside nav header footer form".split())
#: Words in class, id or role that mark what is not the article.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|newsletter|subscribe|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|widget|related|share|sharing|social|comments?|respond|disqus|replies|login|signup|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Frequent words of English, French, Spanish and German.
STOP = set("the of and to in a is that it for on with as was by this at are be an or from not le la les de des du et un une que qui dans pour est sur pas el los las en y con por una del se al der die das und ist ein eine mit von zu den im nicht auf sich für es dem auch".split())
#: Elements that hold the text itself, and class words that make them adverts all the same.
TEXT = set("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption".split()) | INLINE
ADVERTS = set("ad ads advert advertisement sponsor sponsored promo cookie cookies newsletter comment comments".split())
LONG, SHORT, LINKS, DENSITY = 140, 70, 0.5, 0.15
OUT_AT, CORE_AT, LINK_AT, HEADING_AT = range(4)


class Blocks(HTMLParser):
    """Collects (text, characters in links, in core, heading) per block; blocks of what is out are never made.

    inside: how many open elements are out, core, links or headings; opened: how many are open of each name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[bool, bool, bool, bool]]] = []
        self.inside = [0, 0, 0, 0]
        self.opened: Counter = Counter()
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, self.inside[CORE_AT] > 0, self.inside[HEADING_AT] > 0))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self.close_open(tag, CONTAINERS - {tag})
        core, within = tag in CORE, self.inside[CORE_AT] > 0
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        if within and tag in TEXT:  # a paragraph of the article is out only if it says so in a word of its own
            marked = not ADVERTS.isdisjoint(marks.lower().split())
        else:
            marked = tag not in ("body", "html", "article", "main") and bool(MARKS.search(marks)) and not (tag == "header" and within)
        out = tag in OUT or tag == "header" and not (within or core) or marked or any(k == "hidden" for k, _ in attrs)
        what = (out, core, tag == "a", len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        self.stack.append((tag, what))
        self.opened[tag] += 1
        for k in range(4):
            self.inside[k] += what[k]

    def close_open(self, tag, stop):
        if self.opened[tag]:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    self.pop_to(k)
                    return
                if self.stack[k][0] in stop:
                    return

    def pop_to(self, k):
        for tag, what in self.stack[k:]:
            self.opened[tag] -= 1
            for j in range(4):
                self.inside[j] -= what[j]
        del self.stack[k:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash has no meaning on elements that may have content

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop_to(k)
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data):
        if not self.inside[OUT_AT]:
            self.parts.append(data)
            if self.inside[LINK_AT]:
                self.linked += len(data)


def first_pass(text: str, linked: int, heading: bool) -> bool | None:
    if linked > LINKS * len(text):
        return False
    if heading:
        return None
    words = text.lower().split()
    dense = sum(w.strip(".,;:!?\"'()") in STOP for w in words) >= DENSITY * len(words)
    if len(text) >= LONG or len(text) >= SHORT and dense or dense and text[-1] in ".!?" and len(words) >= 5:
        return True
    return None


def extract(html: str) -> str:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if any(c for _, _, c, _ in blocks):  # the page names its article: all of it is text
        return "\n".join(t for t, _, c, _ in blocks if c)
    labels = [first_pass(t, n, h) for t, n, _, h in blocks]
    if True not in labels:  # no block is sure: the undecided ones that are no headings are all there is
        labels = [True if x is None and not b[3] else x for x, b in zip(labels, blocks, strict=True)]
    n = len(blocks)
    before, after = [None] * n, [None] * n  # (distance, label) of the nearest decided neighbours
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for i in order:
            side[i] = None if last is None else (abs(i - last), labels[last])
            if labels[i] is not None:
                last = i
    out = []
    for (text, _, _, heading), label, b, a in zip(blocks, labels, before, after, strict=True):
        if label is None:
            near = [x for x in ((a, b) if heading else (b, a)) if x]
            # a heading goes with what follows it; at equal distance a good neighbour wins
            label = bool(near) and (near[0][1] if heading else any(v for d, v in near if d == min(d for d, _ in near)))
        if label:
            out.append(text)
    return "\n".join(out)


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "html"):
                found = [extract(t) for t in texts]
                yield batch_of(schema, [part.column("page_id"), part.column("url"), found, [len(t) for t in found]])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
