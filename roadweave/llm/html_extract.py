"""Operator 9: main text of web pages by two-pass block rules.

Pass 1 classifies each block by stop-word density, length, link density and the elements it stands
in. Pass 2 gives ambiguous and short blocks the label of the nearest decided neighbours. Pages are
independent: one streaming pass, no shuffle.

Defined cases: null or empty html gives an empty text and 0; broken markup (unclosed tags, stray
``<``) is read as browsers do, as far as text is concerned: an element without an end tag ends where
the one around it does, and a dropped one (a button, say) at the next block; very long pages are read
whole, in time linear in their length; repeated rows answer alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import alnum_words

# Frequent function words of the languages in the corpus.
STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would "
    "der die das und ist von mit den ein eine nicht sich auf für dem zu im des auch als "
    "le la les de des et est un une dans que qui pour pas sur au du en il elle avec par "
    "el los las que y en un una por con no se su para del al lo como más".split()
)
# Elements by their part in a page.
RAW = "script style textarea title iframe"  # their content is no markup
DROPPED = frozenset("noscript template select option button svg object canvas math audio video".split())
ZONES = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = frozenset("article main".split())
REPEATING = frozenset("p li dt dd tr td th option".split())
#: Names of elements around a page's text, and names that the text's own element may bear too.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|side-?bar|widgets?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|shar(?:e|ing)|social|related|"
    r"recommend\w*|bread-?crumbs?|nav\w*|menus?|footer|masthead|comments?|disqus|repl(?:y|ies)|respond|login|signup|search|toolbar|paginat\w+|pager)(?:$|[\s_-])"
)
SURE = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|cookies?|consent|gdpr|side-?bar|nav\w*|menus?|footer|ads?|advert\w*)(?:$|[\s_-])")
ROLES = re.compile(r"""role\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form)\b""")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")
NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Names like sideBar come apart; names like has-sidebar speak of the page's layout, not of what the element holds.
CAMEL, LAYOUT = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"\b(?:has|with|no|without|hide|show)[-_][\w-]*")
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW.split())})\b[^>]*(?<!/)>"
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"'<]|"[^"<]*"|'[^'<]*')*+>|[^>]*>?)|<[!?/][^>]*>?""",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW.split()}


@dataclass
class Rules:
    """Thresholds of pass 1; lengths are in words."""

    short: int = 8
    long: int = 25
    low: float = 0.12
    high: float = 0.25
    max_links: float = 0.4


class Block:
    __slots__ = ("heading", "in_main", "label", "linked", "parts", "text", "zone")

    def __init__(self, zone: bool, in_main: bool, heading: bool):
        self.parts, self.linked, self.zone, self.in_main, self.heading = [], 0, zone, in_main, heading
        self.text, self.label = "", ""


class Node:
    """A tag or a text in page order. ``last``: the item after an element's content; ``closed``: by its own end tag."""

    __slots__ = ("attrs", "closed", "end", "last", "letters", "name", "text")

    def __init__(self, name: str = "", end: bool = False, attrs: str = "", text: str = ""):
        self.name, self.end, self.attrs, self.text = name, end, attrs, text
        self.last, self.closed, self.letters = 0, False, 0


def items_of(page: str) -> list[Node]:
    """Tags and texts; comments, raw elements and declarations go."""
    out, at, lost = [], 0, set()
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            out.append(Node(text=page[at : m.start()]))
        at = m.end()
        raw = (m["raw"] or "").lower()
        if raw:
            found = None if raw in lost else RAW_END[raw].search(page, at)
            if found is not None:
                at = found.end()
            elif raw in ("script", "style"):
                return out  # code up to the end, as in browsers
            else:
                lost.add(raw)  # none stands further on either
        elif m["name"]:
            out.append(Node(m["name"].lower(), bool(m["end"]), m["attrs"]))
    if at < len(page):
        out.append(Node(text=page[at:]))
    return out


def pair_up(items: list[Node]) -> None:
    """Finds where each element ends: at its own end tag, or where the element around it does.

    An inline end tag reaches up to the next block element only. Open names are counted by block, so a
    tag without a partner costs one look-up and the pass is linear in the page.
    """
    stack: list[int] = []
    blocks: dict[str, int] = {}  # open block elements by name
    inline: list[dict[str, int]] = [{}]  # open inline elements by name, since each open block

    def pop(end: int) -> Node:
        e = items[stack.pop()]
        e.last = end
        if e.name in BLOCKS:
            blocks[e.name] -= 1
            inline.pop()
        else:
            inline[-1][e.name] -= 1
        return e

    for i, x in enumerate(items):
        if not x.name or x.name in VOID:
            continue
        of = blocks if x.name in BLOCKS else inline[-1]
        if x.end:
            if of.get(x.name):
                while True:
                    e = pop(i)
                    if e.name == x.name:
                        e.closed = True
                        break
        elif not x.attrs.endswith("/>"):
            if x.name in REPEATING and stack and items[stack[-1]].name == x.name:
                pop(i)
                of = blocks if x.name in BLOCKS else inline[-1]
            of[x.name] = of.get(x.name, 0) + 1
            if x.name in BLOCKS:
                inline.append({})
            stack.append(i)
        else:
            x.last = i
    while stack:
        pop(len(items))
    total = 0
    before = []
    for x in items:
        before.append(total)
        total += len(x.text) - x.text.count(" ") if x.text else 0
    before.append(total)
    for i, x in enumerate(items):
        x.letters = before[x.last] - before[i] if x.last > i else 0


def _named(attrs: str, hints: re.Pattern) -> bool:
    names = (next(filter(None, m), "") for m in NAMES.findall(attrs))
    return any(hints.search(LAYOUT.sub(" ", CAMEL.sub("-", n).lower())) for n in names)


def _is_zone(x: Node, in_main: bool, main_inside: bool, main_elsewhere: bool, letters: int) -> bool:
    """Whether an element is around the text. A name says so only if the element does not hold the text itself.

    That is where it holds the page's main element, or most of the letters of the element that it stands
    in (its page or main element); names that are sure, such as comments, yield only to nearly all.
    """
    if x.name in ZONES or (x.name == "header" and not in_main):
        return True
    if not x.attrs or x.name in ("html", "body", "article", "main"):
        return False
    low = x.attrs.lower()
    if ROLES.search(low) or HIDDEN.search(low):
        return True
    if not _named(x.attrs, HINTS):
        return False
    sure = _named(x.attrs, SURE)
    if main_inside and not main_elsewhere:
        return False
    if main_elsewhere and not in_main:
        return True
    return x.letters <= (0.9 if sure else 0.5) * letters


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; an element's zone and main flags hold for all that it encloses."""
    items = items_of(page)
    pair_up(items)
    mains = [i for i, x in enumerate(items) if x.name in MAIN and not x.end]
    everything = sum(len(x.text) - x.text.count(" ") for x in items if x.text)
    out: list[Block] = []
    until: list[tuple[int, bool, bool, int]] = []  # (end, flags and letters as they were around)
    zone = in_main = heading = False
    letters, silent, silent_open = everything, 0, False  # items before `silent` are in a dropped element
    links = breaks = 0
    now = Block(False, False, False)

    def flush() -> None:
        nonlocal now, breaks
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        now, breaks = Block(zone, in_main, heading), 0

    def put(text: str) -> None:
        nonlocal breaks
        text = html.unescape(text)
        now.parts.append(text)
        if text and not text.isspace():
            breaks = 0
            if links:
                now.linked += len(text.strip())

    for i, x in enumerate(items):
        while until and until[-1][0] <= i:
            _, zone, in_main, letters = until.pop()
        name = x.name
        if i < silent and not (name in BLOCKS and not x.end and silent_open):
            continue
        silent = min(silent, i)
        if not name:
            put(x.text)
            continue
        if x.end:
            links = max(0, links - 1) if name == "a" else links
            heading = False if name[0] == "h" and name[1:].isdigit() else heading
        else:
            if name == "a":
                links += 1
            if name == "br":
                breaks += 1
                put(" ")
                if breaks > 1:
                    flush()
                continue
            if x.last > i:
                if name in DROPPED:
                    silent, silent_open = x.last, not x.closed  # without an end tag of its own it ends at the next block
                    continue
                until.append((x.last, zone, in_main, letters))
                in_main = in_main or name in MAIN
                if not zone:
                    lo, hi = bisect_right(mains, i), bisect_left(mains, x.last)
                    zone = _is_zone(x, in_main, lo < hi, lo + len(mains) - hi > 0, letters)
                letters = x.letters if name in MAIN else letters
            heading = name[0] == "h" and name[1:].isdigit()
        if name in BLOCKS:
            flush()
            links = 0
        elif not x.end and zone != now.zone:
            flush()
    flush()
    return out


def classify(blocks: list[Block], rules: Rules) -> None:
    for b in blocks:
        words = [w for w in alnum_words(b.text.lower())]
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        links = b.linked / len(b.text)
        if b.zone or links > rules.max_links:
            b.label = "bad"
        elif b.heading or len(words) < rules.short:
            b.label = "short"
        elif stops >= rules.high or (stops >= rules.low and len(words) >= rules.long):
            b.label = "good"
        elif b.in_main or stops >= rules.low:
            b.label = "near"
        else:
            b.label = "bad"
    decided = [b.label in ("good", "bad") for b in blocks]
    before, after = [None] * len(blocks), [None] * len(blocks)
    last = None
    for i in range(len(blocks)):
        before[i] = last
        last = i if decided[i] else last
    last = None
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last
        last = i if decided[i] else last
    for i, b in enumerate(blocks):
        if decided[i]:
            continue
        # neighbours across the border of the main element say nothing about what is inside
        near = [(abs(i - j), blocks[j].label) for j in (before[i], after[i]) if j is not None and blocks[j].in_main == b.in_main and not (b.in_main and blocks[j].zone)]
        labels = {x for _, x in near}
        if len(labels) == 1:
            b.label = labels.pop()
        elif not near:
            b.label = "good" if b.in_main else "bad"
        elif b.in_main:
            b.label = "good"
        elif b.heading and after[i] is not None:
            b.label = blocks[after[i]].label
        else:
            b.label = min(near, key=lambda x: (x[0], x[1]))[1]


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    blocks = blocks_of(page or "")
    classify(blocks, rules)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def extracted(batches):
        for b in batches:
            texts = [main_text(x, rules) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "u", "text", "n_chars"])

    return (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), F.col(html_col).alias("html"))
        .mapInArrow(extracted, f"id {kinds[0]}, u {kinds[1]}, text string, n_chars long")
        .select(F.col("id").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")
    )
