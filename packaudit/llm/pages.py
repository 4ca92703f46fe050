"""Main text of web pages by line-block distribution.

A page is stripped to lines, one per block element. Lines inside navigation, forms, adverts, comments and the like keep their
place but lose their text. The text lengths are summed over windows of LINES lines; where the sum surges the content begins, where
it dives to nothing it ends, and the lines between are the text. If the page marks its article (article, main), only lines
inside have a length and any length is a surge; otherwise lines that are mostly links have none, a surge needs SURGE
characters, and stretches much smaller than the largest are left out.

Defined cases: null and empty pages give an empty text; broken markup is read as far as it goes, an element that is never closed
ends with the page; repeated rows and null keys give rows of their own; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LINES = 3
SURGE = 90
#: A stretch is kept if it holds this share of the largest one's characters.
SHARE = 0.25

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>?""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")

RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form header menu dialog button select option datalist".split())
MARKED = frozenset(["article", "main"])
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
                  "tfoot th thead title tr ul".split())
#: Elements that an opening tag of the same kind, or of any block, closes.
OPEN_ENDED = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
              "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
#: Words in class, id or role that say what is not the article.
ASIDE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
                  "breadcrumbs sidebar sidebars widget widgets footer header masthead comment comments reply replies respond disqus "
                  "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
                  "login share sharing social related recommended pagination pager toolbar search complementary contentinfo".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())


def _aside(name: str, attributes: str, inside: bool) -> bool:
    """Is this element none of the article?"""
    if name in DROPPED and not (name == "header" and inside):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    words = {w for _, v in _NAMED.findall(attributes) for w in _WORD.findall(v.lower())}
    return bool(words & (COMMENTS if name in MARKED or name in ("html", "body") else ASIDE))


def lines(page: str) -> list[tuple[str, bool, float]]:
    """(text, inside a marked article, share of linked characters) of each block; blocks that are no content have no text."""
    out: list[tuple[str, bool, float]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []
    skipped = marked = linked = links = 0

    def close_line() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        out.append((text, marked > 0, linked / max(len(text), 1)))
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal skipped, marked, links
        name, aside = stack.pop()
        skipped -= aside
        marked -= name in MARKED
        links -= name == "a"

    def say(text: str) -> None:
        nonlocal linked
        if not skipped and text:
            text = html.unescape(text)
            parts.append(text)
            linked += len(text) if links else 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m.group() == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if m.group(2) is None:
            continue
        name, attributes = m.group(2).lower(), m.group(3)
        if name in BLOCK:
            close_line()
        if m.group(1):
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = at if attributes.endswith("/") else len(page) if end is None else end.end()
            continue
        while stack and name in OPEN_ENDED.get(stack[-1][0], ()):
            pop()
        if name not in VOID and not attributes.endswith("/"):
            aside = _aside(name, attributes, marked > 0)
            stack.append((name, aside))
            skipped += aside
            marked += name in MARKED
            links += name == "a"
    close_line()
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    inside = any(m and t for t, m, _ in found)
    sizes = [0 if not t or (inside and not m) or (not inside and link > 0.5) else len(t) for t, m, link in found]
    surge = 1 if inside else SURGE
    sums = [sum(sizes[i:i + LINES]) for i in range(len(sizes))]
    stretches, i = [], 0
    while i < len(sums):
        if sums[i] >= surge:
            j = i
            while j < len(sums) and sums[j] > 0:
                j += 1
            stretches.append((i, j))
            i = j
        i += 1
    if not stretches and not inside:
        stretches = [(0, len(sums))]
    held = [sum(sizes[a:b]) for a, b in stretches]
    least = 0 if inside else SHARE * max(held, default=0)
    return " ".join(found[k][0] for (a, b), n in zip(stretches, held) if n >= least for k in range(a, b) if sizes[k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    inner = pages.select("page_id", "url", "html")
    kinds = [f.dataType.simpleString() for f in inner.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return inner.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
