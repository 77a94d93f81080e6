"""Main text of web pages by ratios of text and punctuation to nodes on each tag path."""
from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed lists of the HTML standard: elements that break a block, have no end, or hold no text of the page.
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
                  "figure figcaption nav header footer aside form fieldset address details summary dialog hr noscript template svg menu center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp select object".split())
OUTSIDE = frozenset("nav footer aside head noscript template svg dialog menu button".split())
#: Words of class, id and role that speak for parts other than the article.
MARKS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
                  "widget footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social "
                  "related recommended comment comments respond replies reply discussion disqus complementary contentinfo skip pagination pager".split())
#: Marks of a page's head, which inside an article are part of it.
HEADS = frozenset("header masthead topbar banner".split())
ARTICLE = frozenset(("article", "main"))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Containers without a meaning of their own: what stands in one beside the content is not part of it for that.
BOXES = frozenset("div center form details dialog address fieldset".split())
_ROWS, _CELLS = frozenset("thead tbody tfoot tr".split()), frozenset(("td", "th"))

#: Share of the best fused ratio from which a path is content, of the content that an article element must hold to be
#: the root, and of linked text from which a block is a list of links.
THRESHOLD, HELD, LINKED = 0.3, 0.9, 0.6
#: What is left of a ratio under a name made of marks alone, and under a name that has other words too.
FULL, PARTLY = 0.05, 0.5


@dataclass
class Element:
    tag: str
    label: str
    outside: bool
    inside: bool
    marks: tuple[tuple[int, float], ...]
    above: int
    chain: tuple[int, ...]
    tags: tuple[str, ...]


@dataclass
class Block:
    element: Element
    text: str
    linked: int


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order, with the open elements that break blocks."""
    top = Element("", "", False, False, (), 0, (), ())
    stack, out, parts = [top], [], []
    anchor, linked, serial, at, skip = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1], text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not skip:
            parts.append(text)
            if anchor:
                linked += len(text)

    while True:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                anchor = 0
            elif tag == "head":
                skip = 0
            elif tag in BLOCK or tag == "button":
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        flush()
                        del stack[depth:]
                        break
            continue
        if tag == "br":
            add(" ")
        elif tag == "head":
            skip = 1
        elif tag in RAW:
            if not (m[3] or m[6] or "").endswith("/") or tag != "object":
                close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = close.end() if close else len(html)
        elif tag == "a":
            anchor = 1
        elif tag in BLOCK or tag == "button":
            skip = 0 if tag == "body" else skip
            flush()
            closing = {"p"} | _CLOSES.get(tag, set()) if tag != "button" else set()
            while len(stack) > 1 and stack[-1].tag in closing:
                stack.pop()
            if tag in VOID:
                continue
            anchor = 0
            above = stack[-1]
            names = [[w.lower() for w in _WORD.findall(name)] for n in _NAMES.findall(m[3] or m[6] or "") for name in "".join(n).split()]
            words = {w for name in names for w in name}
            inside = above.inside or tag in ARTICLE
            serial += 1
            marks, outer = above.marks, above.above
            if inside and not above.inside:
                outer = len(marks)
            elif tag not in ("html", "body"):
                marking = MARKS - HEADS if inside else MARKS | HEADS
                left = [FULL if marking.issuperset(name) else PARTLY for name in names if not marking.isdisjoint(name)]
                left += [FULL] if tag == "form" or tag == "header" and not inside else []
                marks += ((serial, min(left)),) if left else ()
            stack.append(Element(tag, f"{above.label}>{tag}" + "".join(f".{w}" for w in sorted(words)), above.outside or tag in OUTSIDE, inside, marks, outer,
                                 (*above.chain, serial), (*above.tags, tag)))
    flush()
    return out


def _article(element: Element) -> int:
    """Number of the outermost article or main around an element, 0 without one."""
    return next((serial for serial, tag in zip(element.chain, element.tags) if tag in ARTICLE), 0)


def _common(seeds: list[Block], found: list[Block]) -> tuple[int, ...]:
    """Numbers down to the element that all seeds share: a whole table or list, and the parent of a single block."""
    chains, tags = [b.element.chain for b in seeds], seeds[0].element.tags
    size = 0
    while all(len(c) > size and c[size] == chains[0][size] for c in chains):
        size += 1
    chain = chains[0]
    if size > 1 and len({b.element.chain for b in found if b.element.chain[:size] == chain[:size]}) == 1:
        size -= 1
    cells = {c[i] for b in seeds for c in [b.element.chain] for i, t in enumerate(b.element.tags) if t in _CELLS}
    while size > 1 and (tags[size - 1] in ("li", "dt", "dd") or tags[size - 1] in _ROWS and len(cells) > 1):
        size -= 1
    return chain[:size]


def _beside(element: Element, chain: tuple[int, ...]) -> bool:
    """If an element stands beside a root or one of its parents: a first heading, or text that is in no box of its own."""
    if element.tag == "h1":
        return True
    size = 0
    while size < min(len(chain), len(element.chain)) and chain[size] == element.chain[size]:
        size += 1
    own = element.tags[size:]
    return not BOXES & set(own) and not (own and size and own[0] in _ROWS | _CELLS)


def _marks(found: list[Block]) -> list[dict[int, float]]:
    """Marks of each block with what they leave of its ratio.

    Marks around an article do not count unless another article stands free of them, and none counts that holds most
    of the page's text; a full one does then still where a free article has its share.
    """
    chars = [max(len(b.text) - b.linked, 0) for b in found]
    free = [b.element.inside and not b.element.above for b in found]
    marks = [dict(b.element.marks if any(free) else b.element.marks[b.element.above:]) for b in found]
    held = defaultdict(int)
    for own, n in zip(marks, chars):
        for serial in own:
            held[serial] += n
    named = sum(n for n, f, own in zip(chars, free, marks) if f and not own) > (1 - HELD) * sum(chars)
    return [{s: left for s, left in own.items() if 2 * held[s] <= sum(chars) or left == FULL and named} for own in marks]


def main_text(html: str) -> str:
    """The content blocks of a page, joined by line ends.

    Text length and punctuation are added up for every tag path and divided by its nodes; ratios of paths in an
    article count double, linked text counts against a path, and marks lower its ratio. In page order the ratios are smoothed over neighbours and
    fused with the paths' own; blocks above a share of the best are content. Where articles hold nearly all of them,
    the outermost ones are the root, elsewhere the element that all of them share, with headings and text beside it.
    Blocks of the root belong to it whatever their length, unless they are lists of links or under a mark without a
    block that is content by its path or its own text.
    """
    found = [b for b in blocks(html) if not b.element.outside]
    if not found:
        return ""
    sums = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        s = sums[b.element.label]
        for i, v in enumerate((len(b.text), len(_PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)), 1)):
            s[i] += v
    ratio = {label: (chars - linked) / nodes * (1 + marks / nodes) for label, (chars, marks, linked, nodes) in sums.items()}
    marks = _marks(found)
    own = [ratio[b.element.label] * (2 if b.element.inside else 1) * min(m.values(), default=1) for b, m in zip(found, marks)]
    smooth = [(own[max(i - 1, 0)] + 2 * r + own[min(i + 1, len(own) - 1)]) / 4 for i, r in enumerate(own)]
    fused = [(r * s) ** 0.5 for r, s in zip(own, smooth)]
    least = THRESHOLD * max(fused)
    seeds = [b for b, f in zip(found, fused) if f >= least]
    places = {id(b) for b in seeds}
    articles = {_article(b.element) for b in seeds} - {0}
    sure = [b for b, f, m in zip(found, fused, marks) if f >= least and not m] or seeds
    held = sum(len(b.text) for b in sure if _article(b.element))
    if held and held >= HELD * sum(len(b.text) for b in sure):
        inside = [b for b in found if _article(b.element) in articles]
    else:
        chain = _common(seeds, found)
        inside = [b for b in found if b.element.chain[:len(chain)] == chain or _beside(b.element, chain)]
    content = set()
    for b, m in zip(found, marks):
        alone = (len(b.text) - b.linked) * (1 + len(_PUNCTUATION.findall(b.text))) * (2 if b.element.inside else 1)
        content.update(serial for serial, left in m.items() if id(b) in places or alone * left >= least)
    other = {id(b) for b, m in zip(found, marks) if not content.issuperset(m)}
    kept = [b.text for b in inside if id(b) in places or b.linked < LINKED * len(b.text) and id(b) not in other]
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null and empty html give an empty text, repeated rows repeat."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
