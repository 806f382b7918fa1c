"""HTML extraction by line-block distribution: a page's lines, the text in sliding windows of lines, its surge and dive points.

Markup is stripped to lines, one a block element. Lines of menus, headers, footers, sidebars, notices, adverts, forms and
comments stay as blank lines, as do those outside of the page's article where it marks one; links count for nothing in lines
whose place is not marked. Sums of text over windows of lines surge from nothing where the main text begins and dive to nothing
where it ends; what lies between is kept whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import slices

#: Lines of a window, and the text (code points) that a surge has in one at least, if the page has such a window.
WINDOW, SURGE = 3, 80

# Elements of HTML by what they do to lines.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in "script style textarea title xmp iframe noembed noframes".split()}
APART = frozenset("head nav menu header footer aside form dialog select button search fieldset template noscript svg math object canvas audio video".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that say the same as APART does.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr header masthead menu menubar nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted"
    " related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets modal alert"
    " complementary contentinfo search".split()
)
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_SHORT = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDE = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=$|[\s/=])|aria-hidden\s*=\s*["']?true)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def set_apart(attributes: str) -> bool:
    """Whether class, id or role of an element say that it is no part of the text, or it is hidden."""
    said = [m[1] or m[2] or m[3] or "" for m in _NAMED.finditer(attributes)]
    return any(part.lower() in MARKS for s in said for part in _PARTS.findall(s)) or bool(_HIDE.search(attributes))


@dataclass
class Lines:
    """The lines of a page as they come up: text, and what it counts for in windows (nothing where it is no main text).

    `open` holds the open elements that matter, as [name, kind, how many of that name are open in it]; kind is "main" or "apart".
    """

    texts: list[str] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    open: list[list] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False

    def within(self, kind: str) -> bool:
        return any(k == kind for _, k, _ in self.open)

    def add(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.link:
            self.linked += len("".join(text.split()))

    def end(self) -> None:
        """Ends a line. What is set apart within the article leaves no line, as it does not part the text."""
        text, main, apart = " ".join("".join(self.parts).split()), self.within("main"), self.within("apart")
        if text and not (main and apart):
            self.texts.append("" if apart else text)
            self.weights.append(0 if apart else len(text) if main else max(0, len(text.replace(" ", "")) - self.linked))
            self.inside.append(main)
        self.parts.clear()
        self.linked = 0

    def gap(self) -> None:
        """As many blank lines as part two texts."""
        for column, value in ((self.texts, ""), (self.weights, 0), (self.inside, False)):
            column.extend([value] * WINDOW)

    def enter(self, name: str, attributes: str) -> None:
        main = self.within("main")
        apart = [n for n, k, _ in self.open if k == "apart"]
        kind = None
        if name in MAIN and all(n == "form" for n in apart):  # some pages are one form
            kind = "main"
            if not main:
                self.open.clear()
                self.gap()
        elif not apart and ((name in APART and not (main and name == "header")) or (attributes and name not in ("html", "body") and set_apart(attributes))):
            kind = "apart"
        if kind:
            self.open.append([name, kind, 1])
        else:
            for o in reversed(self.open):
                if o[0] == name:
                    o[2] += 1
                    break

    def leave(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.open[i][2] -= 1
                if not self.open[i][2]:
                    main = self.within("main")
                    del self.open[i:]
                    if main and not self.within("main"):
                        self.gap()
                return


def lines_of(page: str) -> Lines:
    """A page without markup: one line a block element; comments, scripts, styles and titles leave nothing."""
    out, at, n, tag = Lines(), 0, len(page), _TAG
    while at < n:
        up = page.find("<", at)
        if up < 0 or up == n - 1:
            out.add(page[at:])
            break
        if up > at:
            out.add(page[at:up])
        if page.startswith("<!--", up):
            at = page.find("-->", up + 4) + 3
            if at < 3:
                break
            continue
        m = tag.match(page, up)
        if m is None:
            mark = page[up + 1]
            if not (mark in "!?/" or (mark.isascii() and mark.isalpha())):
                out.add("<")
                at = up + 1
                continue
            at = page.find(">", up) + 1
            if not at:
                break  # the page ends in a tag
            m = _SHORT.match(page, up)
            if m is None:
                continue
            tag = _SHORT  # quotes do not pair on this page: each search for their end would read on to the page's end
        at = m.end()
        name, closing = m[1].lower(), page[up + 1] == "/"
        if name in BLOCKS or name in APART or name in RAW:
            out.end()
        elif name in ("br", "hr"):
            out.add(" ")
        if name == "a":
            out.link = not closing
        if closing:
            out.leave(name)
        elif name in RAW:
            end = RAW[name].search(page, at)
            at = end.start() if end else n
        elif name not in VOID:
            if name == "body":
                out.leave("head")
            out.enter(name, m[2])
    out.end()
    return out


def main_text(page: str) -> str:
    """The lines of page between surge and dive points, joined by line feeds.

    Sums over WINDOW lines surge where they leave zero and dive where they return to it. Of what lies between a surge and its
    dive, all is kept, if the sums reach SURGE on the way, or the page's largest sum where that is less.
    """
    lines = lines_of(page)
    marked = any(lines.inside)
    weights = np.array([w if i or not marked else 0 for w, i in zip(lines.weights, lines.inside)], np.int64)
    if not weights.any():
        return ""
    sums = np.concatenate(([0], np.convolve(weights, np.ones(WINDOW, np.int64)), [0]))  # sums[i]: the lines up to i - 1
    some = sums > 0
    surges = np.flatnonzero(some[1:] & ~some[:-1])
    dives = np.flatnonzero(some[:-1] & ~some[1:]) - WINDOW  # the last line that counts
    least = min(SURGE, int(sums.max()))
    kept = []
    for surge, dive in zip(surges.tolist(), dives.tolist()):
        if sums[surge + 1 : dive + WINDOW + 1].max() >= least:
            kept += [t for t, i in zip(lines.texts[surge : dive + 1], lines.inside[surge : dive + 1]) if t and (i or not marked)]
    return "\n".join(kept)


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages: the main text of the whole html, and its code points.

    Null and empty html, and pages without text of their own, give an empty text. Character references are decoded once, white
    space within a line becomes one space. Repeated rows are read each, null ids and urls stay null; an empty table gives no
    row; further columns are ignored. A page is held by one task; batches are cut by bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, RESULT)
