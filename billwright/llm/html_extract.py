"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by where they stand (positive in
text, negative in menus and the like), tags score negative; one linear scan finds the
contiguous region of the highest sum. The weights are log-odds counted on labelled pages
(pages whose article text is known), drawn towards written starting values where few were
seen. Blocks inside the region that are marked as no part of the article are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: element names and marks --------------------------------------------
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSEEN = frozenset("script style noscript template iframe svg canvas object head title".split())
CONTROLS = frozenset("form select option button textarea label fieldset datalist dialog".split())
ASIDE = frozenset("nav footer aside menu".split())
OFF_ELEMENTS = ASIDE | CONTROLS | {"header"}
ARTICLE = frozenset("article main".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
CLOSES_PARAGRAPH = TEXTUAL | frozenset(
    "address article aside details div dl fieldset figure footer form header hr main menu nav "
    "ol section table ul".split()
)
#: A class, id or role word that marks a block as no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo "
    "promotion menu nav navbar navigation navigationbar breadcrumb breadcrumbs sidebar footer "
    "masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended teaser comment "
    "comments commentlist disqus replies respond widget login search pagination pager toolbar "
    "contentinfo complementary alert skip".split()
)
#: Marks that even an article element inside the block does not lift.
LASTING = frozenset("comment comments commentlist disqus replies respond related recommended".split())

#: Labelled pages used for the weights at most (those of the smallest hash).
SAMPLE_PAGES = 2000
#: Words a starting weight counts for.
TRUST = 50.0
MOST = 2.0
LEAST_TAG = -0.02
#: Places: in an article element; outside of it in a paragraph or heading, in a link, or
#: elsewhere; the latter two on pages without any article element; in marked blocks.
START_WORD = {
    "in": 1.5, "out-text": 0.7, "out": 0.1, "bare-text": 1.0, "bare": 0.5, "link": -0.5,
    "off": -1.5,
}
START_TAG = {
    "in": -0.05, "out-text": -0.1, "out": -0.4, "bare-text": -0.1, "bare": -0.2, "link": -0.3,
    "off": -0.8,
}
#: Marked blocks within an article are left out of the text anyway and don't split it.
NEUTRAL = "aside"


# A tag: quotes hold a '>' only behind an equals sign. Possessive, so that no try goes back.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Elements whose content is no markup.
RAW = frozenset("script style".split())


def tokens_of(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kinds are text, start, startend and end.

    One pass: an unfinished comment, script or tag is looked for its end once, and what
    follows the last ``>`` is text, so hostile pages cost no more than others.
    """
    at, shown, size = 0, 0, len(html)
    last = html.rfind(">")
    while at < size:
        at = html.find("<", at)
        if at < 0 or at > last:
            break
        follows = html[at + 1 : at + 2]
        closing = follows == "/"
        initial = html[at + 2 : at + 3] if closing else follows
        if initial.isascii() and initial.isalpha():
            match = _TAG.match(html, at)
            end = match.end() if match else html.find(">", at) + 1
            found = match or _TAG.match(html[at:end].replace("=", " "))
        elif html.startswith("<!--", at):
            end, found = html.find("-->", at + 2) + 3, None
            end = end if end > 2 else size
        elif follows in ("!", "?") or closing:
            end, found = html.find(">", at) + 1, None
        else:
            at += 1  # a sign of its own, part of the text
            continue
        if at > shown:
            yield "text", html[shown:at], ""
        at = shown = end
        if not found:
            continue
        name, rest = found[2].lower(), found[3]
        if closing:
            yield "end", name, ""
            continue
        whole = rest.endswith("/")
        yield ("startend" if whole else "start"), name, rest
        if name in RAW and not whole:
            content = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            at = content.start() if content else size
            if at > shown:
                yield "raw", html[shown:at], ""
            shown = at
    if shown < size:
        yield "text", html[shown:], ""


class _Reader:
    """Turns a page into events: (place, words of a text run or None, block number, text).

    What depends on the open elements is kept as counts, so that an event costs the same at
    any depth.
    """

    def __init__(self):
        self.stack: list[tuple[str, str]] = []  # element and its own zone
        self.open: Counter = Counter()
        self.off = 0  # open elements that stand off by their name
        self.events: list[tuple[str, int, int, str]] = []
        self.block = 0

    def read(self, html: str) -> list[tuple[str, int, int, str]]:
        for kind, value, rest in tokens_of(html):
            if kind == "text":
                self.data(unescape(value))
            elif kind == "raw":
                self.data(value)
            elif kind == "end":
                self.end(value)
            else:
                self.start(value, rest)
                if kind == "startend" and value not in VOID and value in UNSEEN:
                    self.end(value)
        return self.events

    def push(self, name: str, zone: str) -> None:
        self.stack.append((name, zone))
        self.open[name] += 1
        self.off += name in OFF_ELEMENTS

    def cut(self, size: int) -> None:
        """Close all open elements from a depth on."""
        while len(self.stack) > size:
            name, _ = self.stack.pop()
            self.open[name] -= 1
            self.off -= name in OFF_ELEMENTS

    def zone(self) -> str:
        return self.stack[-1][1] if self.stack else "out"

    def place(self) -> str:
        zone = self.zone()
        if zone in ("off-in", "lasting-in"):
            return NEUTRAL
        if zone in ("unseen", "off", "lasting"):
            return "off"
        if zone == "in":
            return "in"
        if self.open["a"]:
            return "link"
        return "out-text" if any(name in TEXTUAL for name, _ in self.stack[-6:]) else "out"

    def tag(self, name: str) -> None:
        if self.zone() != "unseen":
            self.events.append((self.place(), 0, self.block, ""))
        if name not in INLINE:
            self.block += 1

    def start(self, name: str, rest: str) -> None:
        if name in CLOSES_PARAGRAPH:
            self.end_open("p", CLOSES_PARAGRAPH)
        elif name in ("li", "option", "tr", "td", "th", "dt", "dd"):
            self.end_open(name, frozenset(("ul", "ol", "table", "select", "dl")))
        self.tag(name)
        if name not in VOID:
            self.push(name, self.zone_of(name, rest))

    def end(self, name: str) -> None:
        if name != "br" and self.open[name]:
            at = len(self.stack) - 1
            while self.stack[at][0] != name:
                at -= 1
            self.cut(at)
        self.tag(name)

    def end_open(self, name: str, limits: frozenset[str]) -> None:
        """End an open element that a new one closes, unless it stands outside of it."""
        if not self.open[name]:
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != name:
            if self.stack[at][0] in limits:
                return
            at -= 1
        self.cut(at)

    def zone_of(self, name: str, rest: str) -> str:
        zone = self.zone()
        inside = zone in ("in", "off-in", "lasting-in")
        if zone == "unseen" or name in UNSEEN:
            return "unseen"
        if name in ARTICLE and zone not in ("lasting", "lasting-in"):
            return "in" if zone in ("in", "out") or not self.off else zone
        if zone in ("off", "off-in", "lasting", "lasting-in"):
            return zone
        end = "-in" if inside else ""
        if name in ASIDE or name in CONTROLS or (name == "header" and not inside):
            return "off" + end
        if name in ("html", "body"):
            return zone
        marks = set()
        for key, *values in _ATTRIBUTE.findall(rest):
            if key.lower() in ("class", "id", "role"):
                marks.update(re.split(r"[^a-z0-9]+", unescape("".join(values)).lower()))
        if marks & LASTING:
            return "lasting" + end
        return "off" + end if marks & MARKS else zone

    def data(self, data: str) -> None:
        if self.zone() != "unseen":
            self.events.append((self.place(), len(data.split()), self.block, data))


def events_of(html: str) -> list[tuple[str, int, int, str]]:
    events = _Reader().read(html)
    if any(event[0] in ("in", NEUTRAL) for event in events):
        return events
    bare = {"out": "bare", "out-text": "bare-text"}
    return [(bare.get(event[0], event[0]), *event[1:]) for event in events]


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last+1 place of the highest sum (the first such region); empty if none > 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, region = total, (start, at + 1)
    return region


def main_text(html: str, weights: dict[str, float]) -> str:
    """The article of a page: blocks of the best region, joined by one blank."""
    events = events_of(html)
    scores = [
        weights["word " + place] * words if words else (0.0 if text else weights["tag " + place])
        for place, words, _, text in events
    ]
    first, end = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for place, _, block, text in events[first:end]:
        if text and place not in ("off", NEUTRAL):
            blocks.setdefault(block, []).append(text)
    return " ".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def tallies(html: str, article: str) -> Counter:
    """Words and tags by place, inside and outside of the known article of a page."""
    counts: Counter = Counter()
    whole = " ".join(article.split())
    inside = False
    for place, words, _, text in events_of(html):
        if words >= 4:
            inside = " ".join(text.split()) in whole
            counts["word " + place, inside] += words
        elif not text:
            counts["tag " + place, inside] += 1
    return counts


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of standing inside, drawn to the starting values; tags stay negative."""
    weights = {}
    for kind, start in (("word", START_WORD), ("tag", START_TAG)):
        for place, value in start.items():
            name = f"{kind} {place}"
            share = 1 / (1 + math.exp(-value))
            odds = math.log(
                (counts.get((name, True), 0) + TRUST * share)
                / (counts.get((name, False), 0) + TRUST * (1 - share))
            )
            odds = max(-MOST, min(MOST, odds))
            if kind == "tag":
                odds = min(odds, LEAST_TAG)
            elif place == "in":
                odds = max(odds, 0.1)
            weights[name] = odds
    return weights | {f"word {NEUTRAL}": 0.0, f"tag {NEUTRAL}": LEAST_TAG}


def learned_weights(labelled: DataFrame) -> dict[str, float]:
    """Weights from labelled pages (html, article); the driver gets a row per place.

    Without labelled pages the starting values hold. Null html or article count nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html, article in zip(batch.column("html"), batch.column("article"), strict=True):
                if html.as_py() and article.as_py():
                    total.update(tallies(html.as_py(), article.as_py()))
        names = [name for name, _ in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([i for _, i in total], pa.bool_()),
             pa.array(list(total.values()), pa.int64())],
            names=["name", "inside", "n"],
        )

    rows = (
        labelled.select("html", "article")
        .mapInArrow(count, "name string, inside boolean, n long")
        .groupBy("name", "inside")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return weights_from({(r.name, r.inside): r.n for r in rows})


def sampled(pages: DataFrame, key: str = "page_id", at_most: int = SAMPLE_PAGES) -> DataFrame:
    """The pages of the smallest key hashes: a bounded sample to label.

    Only keys are ordered; they are broadcast (``at_most`` rows) to fetch the whole rows.
    """
    keys = pages.select(key).orderBy(F.xxhash64(key), key).limit(at_most)
    return pages.join(F.broadcast(keys.distinct()), key)


def extracted(
    pages: DataFrame, weights: dict[str, float], html: str = "html", name: str = "text"
) -> DataFrame:
    """Add the main text as ``name``; null and empty pages have the empty text.

    Rows keep their partitions, repeated rows are read each, an input column ``name`` is
    replaced. Broken markup never fails: what can't be read as a tag is text. An empty table
    gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (name, html)]
    fields = [*pages.select(*kept).schema.fields, T.StructField(name, T.StringType(), False)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", weights) for h in batch.column(html)]
            columns = [*(batch.column(c) for c in kept), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    return pages.select(*kept, html).mapInArrow(extract, T.StructType(fields))
