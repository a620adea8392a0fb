"""Main text of web pages by the container paths that a host's pages agree on.

1. Each page is read once: its containers score by the text of their own blocks, half of what the next
   container inside them has, links not counted.  From the best one the page climbs to what holds it, up
   to an article or main element or to below the body, as long as that adds no more links than other
   text.  The path of the container it ends at, tags with classes and digits left out, is the page's vote.
2. Votes are added up for every host and path; the path with the most votes wins its host, then the
   greater score, then the path that sorts first.
3. Pages meet their host's winner in a join, which splits a busy host, and are read again: the text comes
   from all containers at the winning path in page order, or at the page's own path where that path is
   missing or empty; a container with more links than other text counts only if it has most other text.

Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles are
left out wherever they are.  Scripts, styles, form fields and hidden elements go outright.  What a tag, role,
class or id only suggests is judged by what it holds: a part that has an article of more text than all
the unsuspected rest of the page stays, and so does one that only a longer name or a form or header tag
makes a suspect if it holds half of the page's text and three times that rest.  Headings in the header of
an article stay.  A block is what block-level tags set apart; its character references are decoded, white
space becomes one blank, and blocks are joined by line breaks.

The page is read in time proportional to its length.  A tag ends at the first > outside quotes; from a tag
on whose quotes never end, quotes are characters like others, and a < with no > after it is text.

A null or empty html gives an empty text, as does a page without text outside the parts left out; a page
without a host votes for itself only; a null page_id or url is kept; repeated rows are pages of their
own; extra columns are ignored; an empty table gives no rows.  Tags are closed as browsers do: a new
paragraph ends the one before, a closing tag ends all it holds, one without a start is ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.shared import map_arrow, materialise

RAW = "script style textarea title noscript template iframe xmp noembed noframes svg".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
ROOT = "#page"  # holds what no other element does
CONTAINER = frozenset("#page article blockquote body center div html main section td".split())
OUTER = frozenset((ROOT, "html", "body"))  # a page doesn't climb to these
TOP = OUTER | {"article", "main"}  # or beyond these
FIELDS = frozenset("button select input label dialog head object embed canvas audio video".split())  # never text of the page
PART_TAGS = frozenset("nav aside footer menu".split())
FORM_TAGS = frozenset("header form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing social "
    "related recommended recommendations newsletter subscribe subscription login signup search pagination pager widget toolbar tags".split()
)
GOOD = frozenset("content article post entry main story text body".split())
WITH = frozenset("has with no without".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3".split())
PART, NAMED = 1, 2  # kinds of suspects: those that only an article inside keeps, and those that a large share keeps too
KEPT_TAGS = frozenset("html body main article".split())
# what a new tag closes, and where the search for it ends
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
STAYS_IN_P = frozenset("table body html".split())

NEXT = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
COMMENT_END = re.compile(r"--!?>")
TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"[^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A page's elements in order, its text outside the parts left out, and its containers' scores."""

    def __init__(self, source: str):
        self.tags, self.paths, self.parents, self.ends = [], [], [], []
        self.hidden, self.suspect, self.good, self.header = [], [], [], []
        self.container, self.link = [], []  # the nearest container; whether the element is in a link
        self.runs: list[tuple[int, int, str]] = []
        self.weights: dict[int, float] = {}
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}  # places in ``open`` by tag
        self.blocks: list[int] = []  # places in ``open`` of blocks, cells and buttons
        self.block = 0
        self._start(ROOT, "")
        self._read(source)
        while self.open:
            self._pop()
        self._judge()

    def _read(self, source: str) -> None:
        at, quotes, last = 0, True, source.rfind(">")
        while found := NEXT.search(source, at):
            begin, inner = found.span()
            if found[0] != "<!--" and begin > last:
                break
            if begin > at:
                self._text(source[at:begin])
            if found[0] == "<!--":
                short = 1 if source.startswith(">", inner) else 2 if source.startswith("->", inner) else 0
                end = None if short else COMMENT_END.search(source, inner)
                at = inner + short if short else end.end() if end else len(source)
                continue
            end = TAG_END.match(source, inner) if quotes and found[0] not in ("<!", "<?") else None
            at = end.end() if end else source.find(">", inner) + 1
            if found[0] in ("<!", "<?"):
                continue
            quotes = quotes and end is not None
            name = NAME.match(source, inner - 1)
            tag = name[0].lower()
            if found[0].startswith("</"):
                self._end(tag)
            elif tag in RAW_END:
                end = RAW_END[tag].search(source, at)
                at = (source.find(">", end.start()) + 1 if end else 0) or len(source)
            else:
                self._start(tag, source[name.end() : at - 1])
        self._text(source[at:])

    def _pop(self) -> None:
        k = self.open.pop()
        self.places[self.tags[k]].pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        self.ends[k] = len(self.tags)
        if self.tags[k] in BLOCK:
            self.block += 1

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _nearest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and tag != "table" and self.blocks and self.tags[self.open[self.blocks[-1]]] == "p":
            self._close(self.blocks[-1])  # an open paragraph ends before the next block
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            place = self._nearest(closed)
            if place > self._nearest(within):
                self._close(place)
        if tag in BLOCK:
            self.block += 1
        if tag == "br" or tag in ("td", "th"):
            self._text(" ")
        if tag in VOID:
            return
        parent = self.open[-1] if self.open else -1
        classes, hidden, good, kinds = [], tag in FIELDS, False, {PART} if tag in PART_TAGS else {NAMED} if tag in FORM_TAGS else set()
        header, readers = tag == "header", False
        if attributes and attributes.strip(" /"):
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id"):
                    for word in value.lower().split():
                        if name == "class":
                            classes.append(re.sub(r"\d+", "", word))
                        pieces = [p for p in re.split(r"[^a-z]+", word) if p]
                        named = [p for i, p in enumerate(pieces) if p in PARTS and not (i and pieces[i - 1] in WITH)]
                        if named and tag not in KEPT_TAGS:
                            kinds.add(NAMED if len(pieces) > 1 else PART)
                            readers |= not READERS.isdisjoint(named)
                            header |= "header" in named
                        good |= any(p in GOOD for p in pieces)
                elif name == "role":
                    if value.lower() in ROLES:
                        kinds.add(NAMED if value.lower() == "form" else PART)
                elif name == "style":
                    hidden |= bool(HIDING.search(value))
                else:
                    hidden |= name == "hidden" or value.lower() == "true"
        k = len(self.tags)
        step = ".".join([tag, *sorted(set(filter(None, classes)))])
        path = f"{self.paths[parent]}>{step}" if parent > 0 else step
        if len(path) > 400:
            path = f"#{xxhash.xxh64_hexdigest(path)}"
        self.tags.append(tag)
        self.paths.append(path)
        self.parents.append(parent)
        self.ends.append(-1)
        self.hidden.append(hidden or (parent >= 0 and self.hidden[parent]))
        kind = min(kinds) if kinds and not readers else PART if kinds else 0
        # a name that also says content makes the element a weaker suspect
        self.suspect.append(NAMED if kind and good and tag not in PART_TAGS else kind)
        self.good.append(good)
        self.header.append(header)
        self.container.append(k if tag in CONTAINER else self.container[parent])
        self.link.append(tag == "a" or (parent >= 0 and self.link[parent]))
        if good or tag in ("article", "main"):
            self.weights[k] = 1.5
        place = len(self.open)
        self.open.append(k)
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCK or tag in ("td", "th", "button"):
            self.blocks.append(place)

    def _end(self, tag: str) -> None:
        places = self.places.get(tag)
        if places:
            self._close(places[-1])

    def _text(self, text: str) -> None:
        node = self.open[-1]
        if text and not self.hidden[node]:
            self.runs.append((node, self.block, text))

    def _judge(self) -> None:
        """Which suspects are left out, by the text they hold; only the other text stays in ``runs``."""
        n = len(self.tags)
        held, free, article = [0] * n, [0] * n, [0] * n
        for node, _, text in self.runs:
            held[node] += len(text.strip())
        free[:] = held
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            held[up] += held[k]
            free[up] += 0 if self.suspect[k] else free[k]
            article[up] = max(article[up], held[k] if self.tags[k] in ("article", "main") else article[k])
        rest = free[0]
        cause = [-1] * n  # the part that an element is left out with
        of_article = [t in ("article", "main") for t in self.tags]
        for k in range(1, n):
            up = self.parents[k]
            cause[k] = cause[up]
            of_article[k] |= of_article[up]
            if cause[k] >= 0:
                by = cause[k]
                if self.tags[k] in HEADINGS and self.header[by] and self.tags[by] not in PART_TAGS and (of_article[by] or self.good[by]):
                    cause[k] = -1
            elif self.suspect[k]:
                large = self.suspect[k] == NAMED and 2 * held[k] >= held[0] and held[k] > 3 * rest
                if large or (article[k] and article[k] > rest):
                    rest += free[k]
                else:
                    cause[k] = k
        self.runs = [run for run in self.runs if cause[run[0]] < 0]

    def scores(self) -> dict[int, float]:
        """Containers with text of their own; text in links counts where there is no other."""
        out: dict[int, float] = {}
        for node, _, text in self.runs:
            size = len(text.strip())
            if not size:
                continue
            size *= 1e-6 if self.link[node] else 1.0
            k = self.container[node]
            out[k] = out.get(k, 0.0) + size
            if k:
                k = self.container[self.parents[k]]
                out[k] = out.get(k, 0.0) + size * 0.5
        return {k: v * self.weights.get(k, 1.0) for k, v in out.items()}

    def best(self) -> int | None:
        found = [(v, -k) for k, v in self.scores().items()]
        return -max(found)[1] if found else None

    def sizes(self) -> tuple[list[int], list[int]]:
        """Text in each element, what it holds included: outside links and within."""
        n = len(self.tags)
        plain, linked = [0] * n, [0] * n
        for node, _, text in self.runs:
            (linked if self.link[node] else plain)[node] += len(text.strip())
        for k in range(n - 1, 0, -1):
            plain[self.parents[k]] += plain[k]
            linked[self.parents[k]] += linked[k]
        return plain, linked

    def main(self) -> int | None:
        """The container that the page climbs to from its best."""
        node = self.best()
        if node is None:
            return None
        plain, linked = self.sizes()
        k = node
        while self.tags[node] not in TOP:
            k = self.container[self.parents[k]]
            if self.tags[k] in OUTER or plain[k] - plain[node] < linked[k] - linked[node]:
                break
            node = k
        return node

    def at(self, path: str) -> list[int]:
        """The containers at a path that hold text."""
        plain, linked = self.sizes()
        found = [k for k, p in enumerate(self.paths) if p == path and self.tags[k] in CONTAINER and (plain[k] or linked[k])]
        most = max((plain[k] for k in found), default=0)
        return [k for k in found if plain[k] >= linked[k] or plain[k] == most]

    def text(self, nodes: list[int]) -> str:
        """The blocks of elements, none of them within another."""
        blocks: dict[int, list[str]] = {}
        starts = sorted(nodes)
        for k, block, text in self.runs:
            i = bisect.bisect_right(starts, k) - 1
            if i >= 0 and k < self.ends[starts[i]]:
                blocks.setdefault(block, []).append(entities.unescape(text))
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def main_text(source: str, path: str | None) -> str:
    page = Page(source)
    if path is not None and (text := page.text(page.at(path))):
        return text
    node = page.main()
    return page.text(page.at(page.paths[node])) if node is not None else ""


def _votes(batches):
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(source.as_py() or "")
            node = page.main()
            if node is not None:
                hosts.append(host)
                paths.append(page.paths[node])
                scores.append(int(max(page.scores().values())))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def _texts(batches):
    for batch in batches:
        texts = [main_text(s.as_py() or "", p) for s, p in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the container path that each host's pages agree on."""
    votes = pages.where("host is not null").select("host", "html").transform(map_arrow, _votes, "host string, path string, score bigint")
    summed = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.when(host != "", host).alias("host")
    )
    winners = materialise(host_paths(pages), "html-paths")
    return pages.join(winners, "host", "left").select("page_id", "url", "html", "path").transform(map_arrow, _texts, "page_id bigint, url string, text string")
