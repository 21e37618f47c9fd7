"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 2).

A tolerant scanner walks the markup with a stack of open elements and cuts the text into leaf blocks: runs of text
inside the same block-level element, with references decoded and white space collapsed. Each block is described by its
ancestors' tags, classes and ids, and by its text: length, links, stops, digits, place in the page. The CRF, trained on
labelled pages, marks each block as main text or not, and Viterbi picks the likeliest sequence for the page.

Defined results: null, empty or text-free pages have the empty text. Scripts, styles, comments and the document head are
markup, never blocks; a script, style, title or text area without an end tag runs to the end of the page. What is inside svg, math, object,
select, template and noscript is dropped up to where HTML ends them; one without an end drops nothing. A < without any > behind it is text.
Elements deeper than ``DEPTH`` keep their text, as parts of the one they are in. Scanning takes time linear in the page. A page without main text gives the empty text. Repeated rows are handled alike.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices
from .crf import Crf
from .labelled_pages import labelled_pages

_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: The rest of a tag: its end is the first > outside quoted values. A quote only opens behind =, and only if it is closed somewhere.
_REST = re.compile(r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>")
_LONG_REFERENCE, _ZEROS = re.compile(r"&#[1-9][0-9]{7,}+;?"), re.compile(r"&#0++(?=[0-9])")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Their content is text up to their own end tag, or to the end of the page.
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
#: Elements whose content is markup, and no block: dropped while they are open.
IGNORED = frozenset("noscript template svg math object select".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements of svg and math whose content is ordinary markup, and elements whose inside an outer end tag doesn't reach.
_HTML_AGAIN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_WALLS = frozenset(("object", "template"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements open at a time, as in browsers: deeper ones are read, but their tags are not remembered. Class and id words of an element.
DEPTH, NAMES = 512, 32
#: Tags of a page whose quotes may swallow all that follows before quotes are no longer looked at.
_ASTRAY = 16
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption button label".split()
)
#: Start tags that end an open element, and the elements that such an end doesn't reach through.
_ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "legend", "button", "label", "summary", "figcaption"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Start tags that end an open svg or math, or an open select.
_ENDS_FOREIGN = BLOCK | frozenset("b big br code em embed i img listing nobr ruby s small span strong strike sub sup tt u var".split())
_MAYBE_SELECT = frozenset(("div", "button", "legend"))
_ENDS_SELECT = BLOCK - _MAYBE_SELECT - {"option", "optgroup", "hr"}


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


class _Tags:
    """Finds the markup of a page from any place on, in time linear in the page."""

    def __init__(self, html: str):
        self.html, self.last, self.astray = html, html.rfind(">"), 0

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it is an end tag, tag or "", attributes) of the next mark; none if the rest is text."""
        html = self.html
        m = _OPENING.search(html, at)
        if m is None:
            return None
        start, at = m.span()
        if m[1]:  # a comment without an end runs to the end of the page
            end = html.find("-->", at - 2)
            return start, len(html) if end < 0 else end + 3, False, "", ""
        if start > self.last:
            return None
        if m[2]:
            return start, html.index(">", at) + 1, False, "", ""
        rest = _REST.match(html, at) if self.astray < _ASTRAY else None
        if rest:
            return start, rest.end(), bool(m[3]), m[4].lower(), rest[1]
        self.astray += 1
        end = html.index(">", at)
        return start, end + 1, bool(m[3]), m[4].lower(), html[at:end]


def _decoded(text: str) -> str:
    """The text with character references decoded; numbers of eight digits and more are no characters."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_REFERENCE.sub("\ufffd", _ZEROS.sub("&#", text))
    return unescape(text)


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found: dict[str, None] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _NAME.finditer(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
            found[f".{w[0]}"] = None
            if len(found) == NAMES:
                return tuple(found)
    return tuple(found)


def _raw_end(tag: str, html: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
    return end.end() if end else len(html)


def _ignored(html: str) -> dict[int, int]:
    """Where the page goes on after each ignored element, by the end of its start tag: behind its own end tag, whatever the nesting;
    for svg, math and select else before the tag that ends them. Any other isn't there, so that it can't take the page along."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    #: Where a select that has no end tag of its own ends at the latest: before the first of these, which it may hold otherwise.
    unsure: dict[int, int] = {}
    at, tags, deeper = 0, _Tags(html), Counter()

    def leave(k: int, to: int) -> None:
        for tag, start in stack[k:]:
            opened[tag] -= 1
            if tag in FOREIGN or tag == "select":
                ends[start] = min(to, unsure.get(start, to))
        del stack[k:]

    while mark := tags.after(at):
        begin, at, ending, tag, attributes = mark
        if not tag:
            continue
        if ending:
            if deeper[tag]:
                deeper[tag] -= 1
            elif opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag and stack[k][0] not in _WALLS:
                    k -= 1
                if stack[k][0] == tag:
                    own = stack[k][1]
                    leave(k, begin)
                    if tag in IGNORED:
                        ends[own] = at
            continue
        inner = next((t for t, _ in reversed(stack) if t in IGNORED or t in _HTML_AGAIN), "") if any(opened[t] for t in IGNORED) else ""
        if (inner in FOREIGN and tag in _ENDS_FOREIGN) or (inner == "select" and (tag in _ENDS_SELECT or tag == "select")):
            leave(max(i for i, (t, _) in enumerate(stack) if t == inner), begin)
        elif inner == "select" and tag in _MAYBE_SELECT:
            unsure.setdefault(next(start for t, start in reversed(stack) if t == inner), begin)
        closed = attributes.endswith("/")
        if tag in RAW:
            if not (closed and inner in FOREIGN):
                at = _raw_end(tag, html, at)
        elif tag not in VOID and (not closed or tag in IGNORED - FOREIGN):
            if len(stack) < DEPTH:
                stack.append((tag, at))
                opened[tag] += 1
            else:
                deeper[tag] += 1
    return ends


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order. ``path`` holds the ancestors' tags, each followed by its dotted class and id words."""
    out: list[Block] = []
    #: Tag, names and path of each open element, how many there are of each tag, and of tags opened beyond ``DEPTH``.
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    deeper: Counter[str] = Counter()
    text: list[str] = []
    linked = links = 0
    at, n, tags = 0, len(html), _Tags(html)
    ignored: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(_decoded("".join(text)).split())
            if joined:
                out.append(Block(joined, stack[-1][2] if stack else (), linked))
            text.clear()
        linked = 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names, (*(stack[-1][2] if stack else ()), tag, *names)))

    def close(k: int) -> None:
        """Drops the stack from its k-th element on."""
        nonlocal links
        if any(tag in BLOCK for tag, _, _ in stack[k:]):
            flush()
        for tag, _, _ in stack[k:]:
            opened[tag] -= 1
            links -= tag == "a"
        del stack[k:]

    def add(s: str) -> None:
        nonlocal linked
        if s:
            text.append(s)
            if links:
                linked += len(s)

    while at < n:
        mark = tags.after(at)
        if mark is None:
            add(html[at:])
            break
        begin, end, ending, tag, attributes = mark
        add(html[at:begin])
        at = end
        if not tag:
            continue
        if ending:
            if deeper[tag]:
                deeper[tag] -= 1
                links -= tag == "a"
                if tag in BLOCK:
                    flush()
                continue
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if opened[tag] else -1
            if k >= 0 and (tag in BLOCK or not any(t in BLOCK for t, _, _ in stack[k + 1 :])):
                close(k)
            elif k >= 0:  # an inline end tag behind a block: the element ends, the block stays
                links -= tag == "a"
                opened[tag] -= 1
                above = stack[k + 1 :]
                del stack[k:]
                for t, names, _ in above:
                    push(t, names)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            at = _raw_end(tag, html, at)
            continue
        if tag in IGNORED:
            if tag in FOREIGN and attributes.endswith("/"):
                continue
            if ignored is None:
                ignored = _ignored(html)
            if at in ignored:
                at = ignored[at]
                continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                add(" ") if tag == "br" else None
            continue
        if tag == "head":
            continue
        if tag in _ENDS_P and opened["p"]:
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p")
            if not any(t in ("button", "td", "table", "li", "div") for t, _, _ in stack[k + 1 :]):
                close(k)
        if tag in _ENDS:
            ended, stop = _ENDS[tag]
            k = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in ended:
                    k = i
            if k < len(stack):
                close(k)
        if tag in BLOCK:
            flush()
        if not attributes.endswith("/"):
            if len(stack) < DEPTH:
                push(tag, _names(attributes))
                opened[tag] += 1
            else:
                deeper[tag] += 1
            links += tag == "a"
    flush()
    return out


def _bucket(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def features(page: list[Block]) -> list[list[str]]:
    """Features of each block, from its path, its text and its place."""
    out = []
    total = len(page)
    leaf = [next((w for w in reversed(b.path) if w[0] != "."), "") for b in page]
    paths: dict[tuple[str, ...], list[str]] = {}
    for i, b in enumerate(page):
        own = paths.get(b.path)
        if own is None:
            own = paths[b.path] = [f"in {w}" for w in dict.fromkeys(b.path)] + [f"leaf {leaf[i]}"]
        words = b.text.count(" ") + 1
        length = _bucket(words, 3, 6, 12, 25, 60)
        link = _bucket(int(10 * b.linked / max(1, len(b.text))), 1, 3, 6, 9)
        stops = sum(b.text.count(c) for c in ".,;")
        mark = ("©" in b.text or "(c) " in b.text.lower()) * 1
        fs = ["bias", *own, f"n{length}", f"l{link}", f"n{length}l{link}", f"leaf {leaf[i]} n{length}", f"leaf {leaf[i]} l{link}", f"stops{_bucket(stops, 1, 2, 5)}", f"last{b.text[-1] in '.!?:'}"]
        if mark:
            fs.append("copyright")
        fs += [f"before {leaf[i - 1]}" if i else "first", f"after {leaf[i + 1]}" if i + 1 < total else "last"]
        if i and page[i - 1].path == b.path:
            fs.append("same path")
        out.append(fs)
    return out


@lru_cache(1)
def model() -> Crf:
    sequences, tags = [], []
    for html, kept in labelled_pages():
        page = blocks(html)
        wanted = list(kept)
        row = []
        for b in page:
            if wanted and b.text == wanted[0]:
                row.append("main")
                wanted.pop(0)
            else:
                row.append("rest")
        if wanted:
            raise ValueError(f"a labelled page misses its block {wanted[0]!r}")
        sequences.append(features(page))
        tags.append(row)
    return Crf.train(sequences, tags, ["rest", "main"])


def texts(pages: list[str], crf: Crf) -> list[str]:
    cut = [blocks(p) if p else [] for p in pages]
    labels = crf.decode([features(b) for b in cut])
    return ["\n".join(b.text for b, c in zip(page, row) if c == "main") for page, row in zip(cut, labels)]


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """One row per page: the key columns, ``text`` and ``n_chars``."""
    crf = model()
    chosen = spread(pages.select(*[F.col(k) for k in keys], F.col(html)))

    def run(batches):
        for batch in batches:
            for part, sources in text_slices(batch, len(keys)):
                found = texts(sources, crf)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*keys, "text", "n_chars"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keys)])
    return chosen.mapInArrow(run, f"{ddl}, text string, n_chars bigint")
