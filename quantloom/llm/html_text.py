"""Main text of raw HTML pages by two passes of block rules.

The page is cut into blocks at block-level tags; scripts, styles, forms and the like are left out. Markup gives each block
a hint: furniture, if it stands in navigation, headers, footers, sidebars, notices, adverts or comment sections by the
tag or by a class, id or role; the article or main element that it stands in; and whether it is a heading.

First pass: a block with a high share of link text is bad, a block with the furniture hint is bad, and any other is
judged by its length and its density of stop words: long and dense ones are good, long ones with few stop words near-good
or, outside articles, bad, and the rest short. Second pass: near-good and short blocks take the label of the nearest
decided blocks on both sides; between two of unlike label the nearer one wins, and near-good blocks lean to good.
Headings count as part of what they head. Blocks of an article look at blocks of the same article only, and are good if
none is decided.

Stop words are those of four languages; on pages that hold few of them, any word of at most three letters counts, and
where words are not parted by spaces length and links alone decide.

Character references are decoded, white space inside a block becomes one space, and blocks are joined in page order by
one space.

Defined cases: NULL and empty pages give an empty text; unclosed and misnested tags are closed by the end of their block
or of the page; a tag that is cut off by the next one or by the end loses its name and its attributes with values, and
what follows is text; an attribute value that misses its closing quote ends at white space; very long pages are read once
from start to end; repeated rows are each extracted; columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.base import chunks, read_table
from quantloom.llm.quality import STOP_WORDS

#: Tags by role.
DROPPED = frozenset("script style noscript template form select option button textarea iframe object embed svg canvas math audio video map head title".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "title")
CHROME = frozenset("nav header footer aside menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BREAKS_ONLY = frozenset("br hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role values of page furniture; the second list says little inside an article.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|footer|foot|copyright|side-?bar|aside|complementary|banner|"
    r"ads?|advert(?:s|isements?|ising)?|sponsor(?:ed)?|promo(?:tion)?|cookies?(?:-?\w+)?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|"
    r"social|comments?(?:-?list|-?section)?|disqus|replies|related|recommend(?:ed|ations?)?|widget|login|signup)(?=$|[\s_-])",
    re.IGNORECASE,
)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:header|masthead|share|sharing|responses|discussion|trending|popular|tags|search)(?=$|[\s_-])", re.IGNORECASE)
STOPS = frozenset(STOP_WORDS)
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS_MOST = 0.15, 0.25, 0.25
#: Share of stop words below which a page is in none of the four languages; letters of a stop word there; of a word without spaces.
KNOWN, BRIEF, RUN = 0.1, 3, 15

# quotes count after an equals sign only; a tag ends before the next one
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/><]*+)((?:[^>=<]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(>|(?=<)|$)|<[!?][^>]*(?:>|$)", re.DOTALL)
_VALUED = re.compile(r"(?:[\s/]*[^\s\"'<>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_CUT_REFERENCE = re.compile(r"&#?\w*$")


@dataclass(frozen=True)
class Block:
    text: str
    links: float  # share of the text that stands in links
    article: int  # number of the article or main element, 0: none
    furniture: bool
    heading: bool


def is_furniture(tag: str, attributes: str, article: bool) -> bool:
    """Whether an element is page furniture by its tag or its class, id or role, or is hidden."""
    if tag in CHROME and not (article and tag == "header"):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    values = [next(filter(None, m.groups()[1:]), "") for m in _ATTRIBUTE.finditer(attributes)]
    return any(FURNITURE.search(v) or not article and DOUBTFUL.search(v) for v in values)


def blocks_of(page: str) -> Iterator[Block]:
    """The blocks of a page that hold text, those in dropped elements apart."""
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, whether dropped, whether furniture, whether an article
    parts: list[tuple[str, bool]] = []
    in_link, heading, at = False, False, 0
    dropped = furniture = within = articles = 0

    def flush() -> Block | None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        linked = sum(len(" ".join(html.unescape(p).split())) for p, link in parts if link)
        parts.clear()
        return Block(text, min(linked / len(text), 1.0), articles if within else 0, furniture > 0, heading) if text else None

    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            parts.append((page[at:stop], in_link))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[4]:  # the tag is cut off: its bare words are text
            at = _VALUED.match(page, m.start(3), at).end()
        if tag in BLOCKS and (block := flush()):
            yield block
        if m[1]:
            if tag == "a":
                in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for _, out, bad, good in stack[k:]:
                        dropped, furniture, within = dropped - out, furniture - bad, within - good
                    del stack[k:]
                    break
            if tag in HEADINGS:
                heading = False
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = True
        if tag in HEADINGS:
            heading = True
        elif tag in BLOCKS and tag not in BREAKS_ONLY:
            heading = False
        if tag in VOID or m[4] and m[3].endswith("/"):
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            _, out, bad, good = stack.pop()
            dropped, furniture, within = dropped - out, furniture - bad, within - good
        if tag in BLOCKS or tag in DROPPED or tag in ("span", "b", "i", "em", "strong", "a") and m[3]:
            out, bad, good = tag in DROPPED, is_furniture(tag, m[3], within > 0), tag in ("article", "main")
            articles += good and not within
            stack.append((tag, out, bad, good))
            dropped, furniture, within = dropped + out, furniture + bad, within + good
    if block := flush():
        yield block


def density(words: list[str], known: bool) -> float:
    """Share of stop words; words without spaces between them tell nothing and pass."""
    if sum(map(len, words)) > RUN * len(words):
        return 1.0
    return sum(w in STOPS if known else len(w) <= BRIEF for w in words) / len(words)


def first_pass(block: Block, known: bool) -> tuple[str, str]:
    """(good, bad, near or short; the rule that says so)."""
    if block.links > LINKS_MOST and not (block.article and block.links < 0.6):
        return "bad", "links"
    if block.furniture:
        return "bad", "markup"
    if len(block.text) < SHORT:
        return "short", "length"
    stops = density(words_of(block.text), known)
    if stops >= STOP_HIGH:
        return "good" if len(block.text) > LONG else "near", "density"
    return "near" if stops >= STOP_LOW or block.article else "bad", "density"


def words_of(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()") for w in text.lower().split()]


def judge(blocks: list[Block]) -> list[tuple[bool, str]]:
    """(whether main text, the rule that decided) of each block."""
    words = [w for b in blocks if not b.furniture for w in words_of(b.text)]
    known = not words or sum(w in STOPS for w in words) >= KNOWN * len(words)
    first = [first_pass(b, known) for b in blocks]
    before: dict[int, int] = {}
    sides: list[list[int]] = []
    for k, b in enumerate(blocks):  # the nearest decided block before each one, of its own article if it stands in one
        sides.append([before[b.article]] if b.article in before else [])
        if first[k][0] in ("good", "bad"):
            before[b.article] = before[0] = k
    after: dict[int, int] = {}
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        sides[k] += [after[b.article]] if b.article in after else []
        if first[k][0] in ("good", "bad"):
            after[b.article] = after[0] = k
    out = []
    for k, (b, (label, rule)) in enumerate(zip(blocks, first, strict=True)):
        if label in ("good", "bad"):
            out.append((label == "good", rule))
            continue
        good = {n: first[n][0] == "good" for n in sides[k]}
        ahead = next((n for n in sides[k] if k < n <= k + 2), None)
        if not good:
            out.append((b.article > 0 or label == "near" or b.links == 0, "alone"))
        elif b.heading and ahead is not None:
            out.append((good[ahead], "heading"))
        elif label == "near":
            out.append((any(good.values()), "neighbours"))
        else:
            out.append((good[min(good, key=lambda n: (abs(n - k), not good[n]))], "neighbours"))
    return out


def read_page(page: str) -> list[Block]:
    """The blocks of a whole page."""
    cut = _CUT_REFERENCE.search(page)  # a page that breaks off inside a character reference
    if cut and cut[0] not in ("&",) and not page.endswith(";") and html.unescape(cut[0]) == cut[0]:
        page = page[: cut.start()] + html.escape(cut[0])
    return list(blocks_of(page))


def main_text(page: str) -> str:
    """The main text of a page."""
    blocks = read_page(page)
    return " ".join(b.text for b, (good, _) in zip(blocks, judge(blocks), strict=True) if good)


def rules_used(pages: DataFrame) -> DataFrame:
    """(rule, main, blocks): by which rule how many blocks of pages were taken or left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for _, raw in chunks(batch, "html"):
                for page in raw:
                    seen.update(judge(read_page(page.decode("utf-8", "replace"))))
            yield pa.RecordBatch.from_arrays([pa.array([r for _, r in seen], pa.string()), pa.array([g for g, _ in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["rule", "main", "n"])

    return pages.select(F.col("html").cast("binary").alias("html")).mapInArrow(run, "rule string, main boolean, n long").groupBy("rule", "main").agg(F.sum("n").alias("blocks"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, raw in chunks(batch, "html"):
                texts = [main_text(p.decode("utf-8", "replace")) for p in raw]
                columns = [batch.column(k).slice(begin, len(raw)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract(read_table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_html": op6_html}
