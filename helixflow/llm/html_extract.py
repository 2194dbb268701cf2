"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements cut the page into lines, each with its text, its tags,
its links and the section that holds it. The ratios of text to tags are smoothed along the page and split in two by
iterated means; sections whose lines lie in the upper cluster, or have sentences of their own, are content. What stands in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments never becomes a line; inside an article, whose
header is its own, names of classes that may as well be a paragraph's only lower its ratio. Parts that a page never closes end where an article or main element starts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head script style noscript template nav header footer aside form button select textarea option iframe svg math object canvas dialog menu label fieldset audio video".split())
RAW = frozenset("script style template noscript iframe svg math textarea title".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTION = frozenset("article main section div td body html blockquote figure".split())
CLOSES_P = BLOCK - {"body", "html"}
#: Words of class, id and role names that mark what is not main text, wherever it stands.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adbox|adslot|adverts?|advertisements?|advertising|adsense|banner|promo|promos|promotion|sponsor|sponsored|nav|navbar|navigation|menu|menus|breadcrumbs?|masthead|footer|sidebar|rail|widget|widgets|"
    r"cookie|cookies|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|comments|commentlist|disqus|pagination|pager|complementary|contentinfo|alertdialog)(?:$|[\s_-]|\d)",
    re.I,
)
#: Words that mark it outside of articles; inside one, where a paragraph may be called so too, they only weigh on a line's ratio.
WEAK = re.compile(
    r"(?:^|[\s_-])(?:header|foot|side|aside|notice|notices|notification|alert|login|share|sharing|social|related|recommended|recommendations|comment|discussion|respond|replies|reply|search|form|skip|toolbar|copyright|legal)(?:$|[\s_-]|\d)",
    re.I,
)
#: What a weak word takes from the ratio of a line in an article, and characters of unlinked text that no other text on a
#: page outweighs: of a line anywhere, and of the best line of an article.
WEAK_TERM, SENTENCE, SHORT_SENTENCE = 1.5, 60, 20
#: Parts that end where an article or main element starts, if the page opens more of them than it closes.
LOOSE = re.compile(r"<(/?)(nav|header|footer|aside|form|menu|noscript|label|button|select|fieldset)\b", re.I)
#: Words that only say that a neighbour exists, and the joints of camelCase names.
BESIDE = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)-\S+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects lines: [text, tags, link characters, section, whether a weak word marks it]. ``sections`` has the depth and name of each section."""

    def __init__(self, loose: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, whether it starts a skipped part, whether a weak word marks it
        self.loose = loose
        self.skipping = self.weak = self.articles = 0
        self.links = 0
        self.text: list[str] = []
        self.tags = 0
        self.link_chars = 0
        self.sections: list[int] = [0]
        self.kinds: list[tuple[str, int]] = [("root", -1)]  # name and parent of each section
        # Where names and groups of names stand in ``open``, so that no end tag walks over it.
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.items: list[int] = []
        self.holders: list[int] = []
        self.noises: list[int] = []

    def cut(self):
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append([text, self.tags, self.link_chars, self.sections[-1], self.weak > 0])
            self.tags = 0
        self.text, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.cut()
            return
        if tag in ("article", "main") and self.noises and self.open[self.noises[-1]][0] in self.loose:
            self.pop_to(self.noises[-1])
        if tag in CLOSES_P and self.blocks and self.open[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        if tag == "li" and self.items and self.open[self.items[-1]][0] == "li":
            self.pop_to(self.items[-1])
        self.tags += 1
        noise, weak = tag in SKIP and not (tag == "header" and self.articles), False
        if not noise and attrs:
            named = dict(attrs)
            marks = " ".join(x for k in ("class", "id", "role") if (x := named.get(k)))
            if marks and tag not in UNMARKED:
                marks = CAMEL.sub("-", BESIDE.sub("", marks))
                weak = bool(WEAK.search(marks))
                noise = bool(NOISE.search(marks)) or weak and not self.articles
            noise = noise or "hidden" in named or named.get("aria-hidden") == "true" or bool(HIDDEN.search(named.get("style") or ""))
        if tag in BLOCK or noise:
            self.cut()
        self.push(tag, noise, weak and not noise and tag in BLOCK)
        if noise:
            self.skipping += 1
        elif tag in SECTION and not self.skipping:
            self.kinds.append((tag, self.sections[-1]))
            self.sections.append(len(self.kinds) - 1)

    def groups(self, tag, noise):
        yield self.at.setdefault(tag, [])
        if tag in BLOCK or tag in SKIP:
            yield self.blocks
        if tag in ("li", "ul", "ol", "menu"):
            yield self.items
        if tag in SECTION:
            yield self.holders
        if noise:
            yield self.noises

    def push(self, tag, noise, weak):
        for group in self.groups(tag, noise):
            group.append(len(self.open))
        self.open.append((tag, noise, weak))
        self.links += tag == "a"
        self.weak += weak
        self.articles += tag in ("article", "main")

    def pop_to(self, k):
        while len(self.open) > k:
            tag, noise, weak = self.open[-1]
            if tag in BLOCK or noise:
                self.cut()
            self.open.pop()
            for group in self.groups(tag, noise):
                group.pop()
            self.weak -= weak
            self.articles -= tag in ("article", "main")
            if noise:
                self.skipping -= 1
            elif tag in SECTION and not self.skipping and len(self.sections) > 1:
                self.sections.pop()
            self.links -= tag == "a"

    def handle_endtag(self, tag):
        places = self.at.get(tag)
        if tag in ("br", "p") and not places:
            self.cut() if tag == "p" else self.text.append(" ")
            return
        self.tags += 1
        if not places:
            return
        inline = tag not in SECTION and tag not in SKIP and tag not in BLOCK
        if not inline or not self.holders or places[-1] > self.holders[-1]:  # else a stray end tag of an inline element
            self.pop_to(places[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a section of an unknown kind is a comment
            return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if not self.skipping:
            self.text.append(data)
            if self.links:
                self.link_chars += len(data.strip())

    def close(self):
        super().close()
        self.pop_to(0)
        self.cut()


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian kernel of radius 3 sigma, weights renewed at the ends."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r:-r] / np.convolve(np.ones(len(values)), kernel)[r:-r]


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers, by iterated means from their midpoint."""
    t = (values.min() + values.max()) / 2
    for _ in range(20):
        low, high = values[values <= t], values[values > t]
        if not len(low) or not len(high):
            return float(values.min()) - 1
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return float(t)


def main_text(html: str | None, sigma: float = 2.0) -> str:
    if not html:
        return ""
    count: dict[str, int] = {}
    for end, name in LOOSE.findall(html):
        count[name.lower()] = count.get(name.lower(), 0) + (-1 if end else 1)
    parser = Lines(frozenset(n for n, c in count.items() if c > 0))
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    kinds = parser.kinds

    def holder(section: int) -> int:
        """The nearest article or main around a section, else the section itself."""
        at, best = section, section
        while at > 0:
            if kinds[at][0] in ("article", "main"):
                best = at
            at = kinds[at][1]
        return best

    around: dict[int, int] = {}
    held = [around[x[3]] if x[3] in around else around.setdefault(x[3], holder(x[3])) for x in lines]
    ratio = np.array([np.log1p(max(len(x[0]) - 2 * x[2], 0)) - np.log1p(x[1]) / 2 - WEAK_TERM * x[4] for x in lines])
    flat = smoothed(ratio, sigma)
    threshold = two_means(flat)
    content = (flat > threshold) | (ratio > np.log1p(SENTENCE))
    # A section stands or falls as a whole, by the text of its lines in either cluster, so that short lines inside
    # it stay. An article or main element is one section; it must pass like any other, or have one sentence of its own.
    weight: dict[int, list[float]] = {}
    best: dict[int, float] = {}
    for h, x, c, r in zip(held, lines, content, ratio, strict=True):
        weight.setdefault(h, [0.0, 0.0])[int(c)] += len(x[0])
        best[h] = max(best.get(h, r), r)
    chosen = {h for h, (low, high) in weight.items() if high >= low or kinds[h][0] in ("article", "main") and best[h] > np.log1p(SHORT_SENTENCE)} or set(held)
    # Of lines with a weak word those that are no content by themselves go.
    return "\n".join(x[0] for x, h, r in zip(lines, held, ratio, strict=True) if h in chosen and not (x[4] and r <= min(threshold, np.log1p(SENTENCE))))


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without ``html``, with text and n_chars (code points). Null or empty html, or a page without content, has
    an empty text. Columns named text or n_chars are replaced; other columns pass; rows are independent."""
    import pyarrow as pa

    own = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*own).schema.add("text", T.StringType()).add("n_chars", T.LongType())

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
