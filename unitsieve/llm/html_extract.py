"""Main text of HTML pages by two-pass block rules.

Pass one looks at each block alone: link density, length and stop-word density
make it good, bad, or undecided (short, or middling). Pass two lets an undecided
block inherit from its nearest decided neighbours in the same section.

Elements are evidence beside the text. Blocks in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are bad from the start. An ``article`` or
``main`` element bounds a section, which is the page's main text only if the rules
find good text in it, or no more good text elsewhere; a page whose articles are mere
link cards is judged block by block, as one without articles is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or our she so that the their there they this to was we were what when which who will with you your
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes un une vos votre vous
    aber als am an auch auf aus bei bin bis bist das dass dem den der des die dies ein eine einem einen einer es für hat ich ihr im in ist ja man mit nach nicht noch nur ob oder sich sie sind so um und uns vom von vor war was wenn wer wie wir zu zum zur
    al como con cuando del donde e el ella ellos entre era es esa ese esta este fue ha hay la las lo los más mi muy ni no nos o para pero por porque que quien se si sin sobre son su sus también te tiene un una uno y ya yo
    """.split()
)

# Element names.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their own end tag.
_RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
#: Their content is markup, but none of the page's text.
_DROPPED = frozenset("noscript template svg object canvas".split())
_FOREIGN = frozenset("svg math".split())
_BOILER = frozenset("nav header footer aside form menu dialog button select fieldset head title".split())
_HEAD = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - frozenset("html head body".split())

#: A comment, a declaration, or a tag. Quotes count after an equals sign only, as in
#: browsers, so a stray one does not swallow what follows.
_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
#: Words in class, id or role that mark boilerplate anywhere.
_ANYWHERE = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|pagination|pager|toolbar|skip"
#: Words that do so outside an article only, whose own title may carry them.
_OUTSIDE = r"side|header|masthead|banner|overlay|widget|legal|disclaimer|copyright|reply"
_PREFIX = r"(?:^|[\s_-])(?<!no-)(?<!with-)(?<!has-)"
_HINT_INSIDE = re.compile(rf"{_PREFIX}(?:{_ANYWHERE})(?=$|[\s_-])", re.I)
_HINT_OUTSIDE = re.compile(rf"{_PREFIX}(?:{_ANYWHERE}|{_OUTSIDE})(?=$|[\s_-])", re.I)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)

LENGTH_LOW = 70
LENGTH_HIGH = 200
STOP_LOW = 0.15
STOP_HIGH = 0.25
LINK_HIGH = 0.4
#: In an article a block is a link if nearly all of it is, and so many in a row are a list of links.
LINK_ONLY, LINK_RUN = 0.9, 3


class Block:
    """Text of one block with what the rules look at."""

    __slots__ = ("boiler", "heading", "label", "linked", "section", "text")

    def __init__(self, text: str, linked: int, section: int, boiler: bool, heading: bool) -> None:
        self.text, self.linked, self.section, self.boiler, self.heading = text, linked, section, boiler, heading
        self.label = ""


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; section 0 lies outside all articles."""
    page = page.replace("\x00", "")
    out: list[Block] = []
    # name, boilerplate, section, in a link, dropped, in foreign markup
    stack: list[tuple[str, bool, int, bool, bool, bool]] = []
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = sections = 0

    def now() -> tuple[bool, int, bool, bool, bool]:
        return stack[-1][1:] if stack else (False, 0, False, False, False)

    def close(depth: int, all_above: bool = True) -> None:
        gone = stack[depth:] if all_above else [stack[depth]]
        is_open.subtract(x[0] for x in gone)
        del stack[depth : len(stack) if all_above else depth + 1]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                boiler, section = now()[:2]
                out.append(Block(text, linked, section, boiler, any(x[0] in _HEAD for x in stack[-3:])))
            parts.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not now()[3]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if now()[2]:
                linked += len("".join(text.split()))

    at = 0
    while m := _MARKUP.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name in _BLOCK:
            flush()
        if name in _RAW and not m[1]:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            parts.append(" ")
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1) if is_open[name] > 0 else ():
                if stack[depth][0] == name:
                    # an inline end tag does not close the blocks it crosses
                    close(depth, name in _BLOCK or not any(x[0] in _BLOCK for x in stack[depth:]))
                    break
        elif name not in _VOID and not (m[3].endswith("/") and (name in _FOREIGN or now()[4])):
            if name in _CLOSES_P:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p" or (name == "li" and stack[depth][0] == "li"):
                        close(depth)
                        break
                    if stack[depth][0] in _BLOCK:
                        break
            boiler, section, link, dropped, foreign = now()
            if name in ("article", "main") and not boiler and not section:
                sections += 1
                section = sections
            if not boiler:
                inside = section and name == "header"  # an article's own header holds its title
                boiler = (name in _BOILER and not inside) or name in _DROPPED
                if m[3] and not boiler and name not in ("html", "body"):
                    hint = " ".join(a or b or c for a, b, c in _ATTR.findall(m[3]))
                    boiler = bool((hint and (_HINT_INSIDE if section else _HINT_OUTSIDE).search(hint)) or _HIDDEN.search(m[3]))
            stack.append((name, boiler, section, link or name == "a", dropped or name in _DROPPED, foreign or name in _FOREIGN))
            is_open[name] += 1
    say(page[at:])
    flush()
    return out


def first_pass(block: Block) -> str:
    """good, bad, near (middling), short or link, from the block alone."""
    if block.boiler:
        return "bad"
    length = len(block.text)
    link = block.linked / max(1, length - block.text.count(" "))
    if link > LINK_HIGH and not block.section:
        return "bad"
    if link > LINK_ONLY and not block.heading:
        return "link"
    if length < LENGTH_HIGH and not block.section and _RIGHTS.search(block.text):
        return "bad"
    if length < LENGTH_LOW or block.heading:
        return "short"
    words = _WORD.findall(block.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH:
        return "good" if length > LENGTH_HIGH else "near"
    if stop >= STOP_LOW:
        return "near"
    return "near" if block.section else "bad"


def _settle_links(blocks: list[Block]) -> None:
    """Link-only blocks of an article are bad in a row of them, else short."""
    at = 0
    while at < len(blocks):
        end = at
        while end < len(blocks) and blocks[end].label == "link" and blocks[end].section == blocks[at].section:
            end += 1
        for b in blocks[at:end]:
            b.label = "bad" if end - at >= LINK_RUN else "short"
        at = max(end, at + 1)


def _main_sections(blocks: list[Block]) -> set[int]:
    """Sections that hold the main text; none if the page is to be judged as a whole."""
    good = {b.section for b in blocks if b.section and b.label == "good"}
    if good:
        return good
    inside = sum(len(b.text) for b in blocks if b.section and b.label in ("near", "short"))
    outside = sum(len(b.text) for b in blocks if not b.section and b.label == "good")
    return {b.section for b in blocks if b.section and not b.boiler} if inside > outside else set()


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes; the blocks to keep, in order."""
    for b in blocks:
        b.label = first_pass(b)
    _settle_links(blocks)
    main = _main_sections(blocks)
    if not main and any(b.section for b in blocks):
        for b in blocks:
            b.section = 0
            b.label = first_pass(b)
    n = len(blocks)
    before: list[tuple[str, int]] = [("", n)] * n
    after: list[tuple[str, int]] = [("", n)] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[str, int]] = {}
        for i in order:
            b = blocks[i]
            found[i] = last.get(b.section, ("", 2 * n))
            # what is set into an article from outside, such as adverts, does not colour its text
            if not (b.boiler and b.section) and b.label in ("good", "bad"):
                last[b.section] = (b.label, i)
    kept = []
    for i, b in enumerate(blocks):
        label = b.label
        if main and b.section not in main:
            label = "bad"
        elif label in ("near", "short"):
            (left, at_left), (right, at_right) = before[i], after[i]
            if left and right and left != right:
                nearer = left if i - at_left <= at_right - i else right
                # a heading belongs to what follows it
                label = right if b.heading else "good" if b.section or label == "near" else nearer
            else:
                label = left or right or ("good" if b.section or label == "near" else "bad")
        if label == "good":
            kept.append(b)
    if not kept and not main:
        kept = [b for b in blocks if not b.boiler and b.label in ("near", "short") and not b.linked]
    return kept


def main_text(page: str | None) -> str:
    """The page's main text: kept blocks joined by LF; empty for null or no text."""
    if not page:
        return ""
    return "\n".join(b.text for b in classify(blocks_of(page)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every row of ``pages``.

    Columns of these names are replaced, ``html_col`` is dropped, all others pass.
    Null and empty pages give an empty text; malformed markup is read as browsers do
    (an unclosed comment or script runs to the end of the page, a stray quote ends
    nothing), pages of any length are read whole; where neighbours on both sides are
    equally near, the one before decides; repeated rows stay; an empty table gives an
    empty result.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            yield series.map(main_text, na_action=None)

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*rest, run(F.col(html_col).cast("string")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


__all__ = ["STOP_WORDS", "Block", "blocks_of", "classify", "extract", "first_pass", "main_text"]
