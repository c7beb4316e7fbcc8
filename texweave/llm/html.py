"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags. Blocks inside navigation, headers, footers, asides,
forms and the like, or in elements whose class or id says so, are bad. The first pass judges
the others by length, link density and stop-word density: good, bad, or undecided if short.
In the second pass undecided blocks inherit the label of the nearest decided neighbours. In
an element that marks the article only its own blocks count, low stop-word density and links
decide nothing, and an undecided block other than a paragraph or heading is bad only between two
bad ones. Elsewhere it is good between good ones, or as a heading before one. A page without any
good block keeps its undecided ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Function words of the languages that pages come in.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can do for from had has have he her his how i if in into is it its
    more no not of on one or our out she so than that the their them then there these they this to up was we were what when
    which who will with would you your
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui ma mais me mes ne nos nous on ou par pas
    plus pour qu que qui sa sans se ses son sont sur ta te un une vos votre vous y
    aber als am auch auf aus bei bin bis da das dem den der des die doch du durch ein eine einem einen einer es für hat ich
    ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wer wie wir
    zu zum zur
    al como con cuando de del donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos o
    para pero por que se ser si sin sobre son su sus también te tiene un una uno y ya""".split()
)
SHORT = 70  # characters below which a block is too short to judge
LONG = 200
MOST_LINKED = 0.33
LEAST_STOP = 0.25
_RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes")  # hold text, not elements
_DROP = frozenset("noscript template svg select button head".split())
_KEPT = ("noscript",)  # in a marked article
_CONTROL = ("select", "button")  # one that is never closed ends where prose begins
_PROSE = frozenset("article blockquote figure h1 h2 h3 h4 h5 h6 main ol p pre section table ul xmp".split())
_HEAD = frozenset("base link meta noscript script style template title".split())  # what a head can hold
_BAD = ("nav", "footer", "aside", "form", "menu", "dialog")
_REGION = ("article", "main")
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr
    ul xmp""".split()
)
_HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class names, ids and roles that speak of something else than the article.
_OTHER = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|hidden|login|menu|modal|nav\w*"
    r"|newsletter|notices?|pagination|popup|promo\w*|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)\d*",
    re.I,
)
# In a marked article every word of a name has to be one of these or of _FURNITURE: a section may be about navy history or hidden costs.
_INSIDE = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer hidden login menu modal
    nav navbar navigation newsletter notice notices pagination popup promo promos promotion replies share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget widgets""".split()
)
_FURNITURE = frozenset(
    """area article articles author bar block body bottom box btn button buttons container content entry form group header holder icon icons inline inner item
    items left link links list main middle outer page panel post pre right row section site slot small sticky story tag thread title top unit up wrap wrapper
    zone""".split()
)
_RELATED = re.compile(r"related(?:[-_]?(?:articles?|content|items?|links?|news|posts?|products?|reading|stories|topics?))?", re.I)
_ABOUT = ("has", "no", "with", "without", "is")  # "has-sidebar" describes a page, not a sidebar
_CONTENT = ("article", "content", "entry", "main", "post", "section", "story", "title")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_UNQUOTED = re.compile("[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


def _tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """Text, and then closing, name and attributes of the tag after it (name "" at the page's end): one pass, each character read a few times.

    A tag ends at the first > outside quotes. From the first tag on whose quotes never close, > ends
    any tag. What follows a tag that never ends goes; a comment that never ends goes with what follows.
    """
    at, quoted, ends = 0, True, {}
    text: list[str] = []
    while (start := page.find("<", at)) >= 0:
        text.append(page[at:start])
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if page.startswith(("<!", "<?", "</"), start):
                mark = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(mark, start + 2)
                at = end + len(mark) if end >= 0 else len(page)
            else:
                text.append("<")
                at = start + 1
            continue
        end = name.end()
        while quoted:
            end = _UNQUOTED.match(page, end).end()
            if end == len(page):
                quoted = False
            elif page[end] == ">":
                break
            else:
                quoted = (end := page.find(page[end], end + 1) + 1) > 0
        if not quoted and (end := page.find(">", name.end())) < 0:
            at = len(page)
            break
        kind = name[0].lower()
        yield "".join(text), closing, kind, page[name.end() : end]
        text, at = [], end + 1
        if kind in _RAW and not closing:
            if ends.get(kind, at) < len(page):  # else there was no end tag further left, so there is none here
                found = re.compile(rf"</{kind}(?=[\s/>])", re.I).search(page, at)
                ends[kind] = at = found.start() if found else len(page)
            else:
                at = len(page)
    text.append(page[at:])
    yield "".join(text), False, "", ""


def _speaks_of_other(names: str, inside: bool) -> bool:
    """Whether a class, an id or a role speaks of something else than the article."""
    for name in names.split():
        words = re.split("[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if words[0] in _ABOUT:
            continue
        if _RELATED.fullmatch(name):
            return True
        if inside:
            words = [w for w in (re.sub(r"\d+$", "", w) for w in words) if w]
            if any(w in _INSIDE for w in words) and all(w in _INSIDE or w in _FURNITURE for w in words):
                return True
            continue
        for k, word in enumerate(words):
            if _OTHER.fullmatch(word) and not (word == "header" and words[max(k - 1, 0)] in _CONTENT):
                return True
    return False


def _blocks(page: str) -> Iterator[tuple[str, int, bool, int, str]]:
    """text, characters in links, whether its place is bad, its region (0: none) and its tag, of every block with text."""
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # open elements: tag; and with all around: bad, region, dropped
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, regions, tag = 0, False, 0, ""

    def flush() -> Iterator[tuple[str, int, bool, int, str]]:
        nonlocal linked, links
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            yield text, linked, stack[-1][1], stack[-1][2], tag
        parts.clear()
        linked, links = 0, False

    def close(name: str) -> None:
        nonlocal tag
        while True:
            last = stack.pop()[0]
            open_[last] -= 1
            if last == name:
                break
        tag = stack[-1][0]

    for raw, closing, name, rest in _tags(page):
        if raw and not stack[-1][3]:
            parts.append(text := unescape(raw))
            linked += len(text.strip()) if links else 0
        if not closing and open_["head"] and name not in _HEAD and name != "head":
            close("head")
        if name in _RAW or not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links = not closing and any(k.lower() == "href" for k, *_ in _ATTRIBUTE.findall(rest))
            continue
        block = name in _BLOCK
        if closing:
            if block:
                yield from flush()
            if open_[name]:
                close(name)
            continue
        if block:
            yield from flush()
            if name in _PROSE:
                for control in _CONTROL:
                    if open_[control]:
                        close(control)
            if stack[-1][0] == "p" or name in ("li", *_HEADING) and stack[-1][0] == name:
                close(stack[-1][0])
            tag = name
        if name in _VOID or rest.endswith("/"):
            continue
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
        _, bad, region, dropped = stack[-1]
        hint = name not in ("body", "html", *_REGION) and not (region and name in _HEADING) and any(_speaks_of_other(given[k], region > 0) for k in ("class", "id", "role") if given.get(k))
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(given.get("style", "")))
        bad_here = name in _BAD or name == "header" and not region or hint or hidden
        drop_here = name in _DROP and not (region and name in _KEPT) or bad_here and not block  # an inline element leaves the block around it whole
        if block or drop_here:
            regions += name in _REGION
            stack.append((name, bad or bad_here, regions if name in _REGION else region, dropped or drop_here))
            open_[name] += 1
    yield from flush()


def _first_pass(text: str, linked: int, bad: bool, marked: bool, stop: float, listed: bool) -> bool | None:
    if bad:
        return False
    if linked > MOST_LINKED * len(text):
        return None if marked else False
    if len(text) < SHORT:
        return None
    if stop >= LEAST_STOP:
        return True
    if marked or len(text) < LONG or stop > 0:
        return None
    return not listed  # a long text without any of the stop words: of a language that the list lacks, if the page has no other


def _stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _nearer(blocks: list[tuple], ends: list[int], label: list[bool | None], k: int, before: int | None, after: int | None) -> bool:
    """Whether a short paragraph or list entry between a good and a bad neighbour is the article's: it has few links, and the bad one is bad by its own place or no nearer, in characters.

    ``ends`` are the characters of all blocks up to and with each, so any distance is one difference.
    """
    if blocks[k][1] > MOST_LINKED * len(blocks[k][0]):
        return False
    if any(blocks[j][2] for j in (before, after) if j is not None and not label[j]):
        return True
    gap = {label[j]: ends[max(j, k) - 1] - ends[min(j, k)] for j in (before, after) if j is not None}
    return gap[True] <= gap[False]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by an empty line; empty for a null page or one without main text.

    In an element that marks the article only hints, not link density, make a block bad. Character
    references are decoded, malformed tags end where ``_tags`` says, and elements that are never
    closed end with their parent. Time grows with the page's length.
    """
    blocks = list(_blocks(page or ""))
    stops = [_stop_share(b[0]) for b in blocks]
    listed = any(x >= LEAST_STOP and len(b[0]) >= SHORT for x, b in zip(stops, blocks, strict=True))
    label = [_first_pass(text, linked, bad, region > 0, stop, listed) for (text, linked, bad, region, _), stop in zip(blocks, stops, strict=True)]
    region = [r for *_, r, _ in blocks]
    any_region = any(region)
    ends = list(accumulate(len(b[0]) for b in blocks))
    decided = [k for k, x in enumerate(label) if x is not None]
    out = list(label)
    before = None
    after = iter(decided)
    nxt = next(after, None)
    for k, x in enumerate(label):
        while nxt is not None and nxt <= k:
            nxt = next(after, None)
        if x is not None:
            before = k
            continue
        if region[k]:
            near = [label[j] for j in (before, nxt) if j is not None and region[j] == region[k]]
            out[k] = len(near) < 2 or any(near) or blocks[k][4] in _HEADING or blocks[k][4] == "p"
        elif any_region:
            out[k] = False
        else:
            near = [label[j] for j in (before, nxt) if j is not None]
            heads = blocks[k][4] in _HEADING and nxt is not None and bool(label[nxt])
            out[k] = any(near) and (all(near) or heads or blocks[k][4] in ("p", "li") and _nearer(blocks, ends, label, k, before, nxt))
    if any_region:  # a page that marks its article has nothing of it outside
        out = [bool(x and r) for x, r in zip(out, region, strict=True)]
    if not any(out):
        out = [x is None for x in label]
    return "\n\n".join(b[0] for b, x in zip(blocks, out, strict=True) if x)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        sizes = pa.array(map(len, texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty html gives an empty text; a long or malformed page is read whole in time that
    grows with its length. Repeated rows repeat, other columns of ``pages`` stay out, and an empty
    table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, _text_batches, "page_id long, url string, text string, n_chars long")
