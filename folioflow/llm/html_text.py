"""Main text of HTML pages by text-to-tag ratio (operator 10).

Elements that never hold text (scripts, styles) are skipped. What tags or class names say to be around an article is set
aside, unless nothing that reads like prose is left without it; the rest is judged by its ratio alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without text of a page, and elements that stand around an article.
SILENT = frozenset("head title script style noscript template select option textarea iframe object canvas svg math audio video".split())
AROUND = frozenset("nav footer aside form button input label dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold an article; a header inside one belongs to it.
HOLDERS = frozenset(("article", "main"))
#: Words of a class, id or role that mark what surrounds articles.
MARKED = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo banner comment comments disqus replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe popup modal overlay sidebar side related recommended share social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead pagination pager widget toolbar complementary contentinfo search".split())
SIGMA = 1.5
#: Elements that are part of the block around them: a heading stands or falls with its text.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 hr li dt dd pre blockquote address center figure figcaption header".split())
#: Regions that belong to the text around them if they have no link.
LISTS = frozenset("ul ol dl table thead tbody tfoot tr td th".split())
#: What the ratio of a block inside a holder is multiplied by; it never decides alone.
WEIGHT = 1.5
#: Characters to a tag that are text wherever the clusters part.
PROSE = 40
#: How much longer prose must be than the rest of the page for a marked name to be wrong.
OUTWEIGHS = 10
_SPACE = re.compile(r"\s+")
_CUT = re.compile(r"<[A-Za-z/!?][^<>]*\Z")


class Lines(HTMLParser):
    """Blocks of text in page order, each with its tags and the region and the set-aside element it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.count: Counter = Counter()
        self.silent, self.held = 0, 0
        #: Open regions, and of every region its parent, whether it is a list, and whether it has a link.
        self.regions, self.known = [0], [[0, False, False]]
        #: Open elements that are set aside, the parent of each such element (0 is the page), and those that must stay so.
        self.aside, self.around, self.surely = [0], [0], {0}
        self.buffer: list[tuple[int, str]] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, bool, int]] = []

    def flush(self):
        apart: dict[int, list[str]] = {}
        for where, text in self.buffer:
            apart.setdefault(where, []).append(text)
        for where, texts in apart.items():
            text = _SPACE.sub(" ", "".join(texts)).strip()
            if text:
                self.lines.append((text, self.tags, self.regions[-1], self.held > 0, where))
                self.tags = 0
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.buffer.append((self.aside[-1], " "))
        elif tag == "a":
            self.known[self.regions[-1]][2] = True
        if tag in VOID:
            return
        if tag in HOLDERS:
            while self.silent or len(self.aside) > 1:
                self.close_last()
            self.held += 1
        named = dict(attrs)
        words = re.split(r"[^a-z0-9]+", " ".join(named.get(k) or "" for k in ("class", "id", "role")).lower())
        silent = tag in SILENT
        aside = tag in AROUND or (tag == "header" and not self.held) or (tag not in ("body", "html", "article", "main", "p") and not MARKED.isdisjoint(words)) or "hidden" in named
        if tag in BLOCKS or silent or aside:
            self.open.append((tag, silent, aside))
            self.count[tag] += 1
            self.silent += silent
            if aside:
                self.around.append(self.aside[-1])
                self.aside.append(len(self.around) - 1)
                if tag in AROUND and tag != "form":
                    self.surely.add(self.aside[-1])
            if tag not in INNER:
                self.known.append([self.regions[-1], tag in LISTS, False])
                self.regions.append(len(self.known) - 1)

    def close_last(self):
        tag, silent, aside = self.open.pop()
        self.count[tag] -= 1
        self.silent -= silent
        if aside:
            self.aside.pop()
        self.held -= tag in HOLDERS
        if tag not in INNER:
            self.regions.pop()
        return tag

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if self.count[tag]:
            while self.close_last() != tag:
                pass

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append((self.aside[-1], data))

    def kept(self) -> list[tuple[str, int, int, bool]]:
        """The lines outside what is set aside. If they are not prose, and a form or an element with a marked name has some
        OUTWEIGHS times as long, that element is taken back in; what is set aside beside or inside it stays so."""
        prose, plain = [0] * len(self.around), 0
        for text, tags, _, _, where in self.lines:
            if len(text) >= PROSE * max(1, tags):
                prose[where] += len(text)
            plain += 0 if where else len(text)
        back = {0}
        if not prose[0]:
            whole, inner = prose[:], defaultdict(list)
            for where in reversed(range(1, len(prose))):
                if where not in self.surely:
                    whole[self.around[where]] += whole[where]
                    inner[self.around[where]].append(where)
            at = 0
            while not prose[at] and inner[at]:
                at = max(inner[at], key=lambda w: (whole[w], -w))
                if whole[at] < OUTWEIGHS * plain or not whole[at]:
                    break
                back.add(at)
        return [line[:4] for line in self.lines if line[4] in back]


def split_high(values: list[float]) -> float:
    """The threshold between the two clusters of values (2-means from the extremes); at most the least value
    if they are all alike."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not a or not b:
            break
        now = sum(a) / len(a), sum(b) / len(b)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2 if high > low else low


def main_text(html: str | None) -> str:
    """The blocks of the regions whose smoothed text-to-tag ratio is in the upper cluster, one to a line. Being inside
    an article or main raises the ratio and no more."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(_CUT.sub("", html))
    parser.close()
    parser.flush()
    lines = parser.kept()
    if not lines:
        return ""
    # Logarithms, so that one long paragraph doesn't make short ones look like menus.
    ratio = [math.log1p(len(text) / max(1, tags) * (WEIGHT if held else 1)) for text, tags, _, held in lines]
    reach = math.ceil(3 * SIGMA)
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratio)):
        near = [(kernel[j - i + reach], ratio[j]) for j in range(max(0, i - reach), min(len(ratio), i + reach + 1))]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    # A region is judged whole, by the mean over its characters: short paragraphs beside long ones are text too.
    sums: dict[int, list[float]] = {}
    for (text, _, region, _), v in zip(lines, smooth):
        total = sums.setdefault(region, [0, 0])
        total[0] += len(text) * v
        total[1] += len(text)
    means = {region: v / n for region, (v, n) in sums.items()}
    cut = min(split_high(smooth), math.log1p(PROSE), max(means.values()))
    wanted = {region for region, v in means.items() if v >= cut}
    for region, (parent, is_list, linked) in enumerate(parser.known):
        if is_list and not linked and parent in wanted:
            wanted.add(region)
    return "\n".join(text for text, _, region, _ in lines if region in wanted)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every page. A null or empty page has an empty text; null ids and urls stay
    null, repeated rows are extracted again, and other columns are ignored."""
    short_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
