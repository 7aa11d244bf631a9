"""HTML extraction (2): tree scoring.

A page is read once into a tree of elements and a list of blocks (the text between two borders of block
elements). Elements that are menus, headers, footers, sidebars, notices, adverts, forms, comments and the like,
by tag, role, class or id, are cut off with all they hold. A class or id says so if each of its words does or says nothing
(`cookie-notice`, `sidebar-left`; not `social-science`, and not `has-sidebar`, which is of a neighbour). Forms, and elements that are only named so, stay
if they hold an article or main element, or most of the page's prose (unless named as comments, adverts or consent). Each block passes points for its length and its commas
to the element that holds its paragraph, half of them to the next one up; an element's points are discounted by the
share of its text that is in links. The element of most points is the container, whatever its tag is; its siblings stay if their points come
near, or if they are of its kind (tag and class) and not mostly links; so do, further up, siblings of what holds the container
that are of that one's kind and whose points come near. Paragraphs and headings beside the container, and text beside it that is in no element
of its own, pass their points on and have none; each of these stays unless more than half of it is in links, however short it is, as
what goes is known by its names or its links. What is returned are all blocks of these, in page order.

A block is one line: character references decoded, white space as one space, trimmed. `<br>` is white space.

Defined cases: null or empty html, and pages without text, give an empty text; markup that isn't closed ends with
what holds it; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset("nav header footer aside script style noscript svg math button select textarea iframe template dialog menu head title object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul caption".split()
)
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements past which no closing looks.
WALLS = frozenset("table ul ol dl div section article main body html td th blockquote aside nav header footer form".split())
WORDS_CUT = frozenset(
    "ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words of a name that say nothing by themselves, and those after which a name is of something else.
FILLERS = frozenset("a area articles bar block bottom box buttons container content div fixed global group icons inner item items layer left links list main media module outer overlay page panel post posts primary right row secondary section site slot sticky top unit wrap wrapper".split())
OTHERS = frozenset("has with no without hide show".split())
#: What is never spared, however much it holds.
WORDS_GONE = frozenset("ad ads adv advert advertisement adsense comment comments cookie cookies consent disqus discussion gdpr newsletter replies respond sponsor sponsored".split())
ROLES_CUT = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
GOOD = re.compile(r"\b(?:article|body|content|entry|main|post|story|text)\b")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")  # an unquoted value may end with a slash of its own
SPACES = re.compile(r"\s+")
#: Paragraphs and headings, which are judged by their own text, and the most of it that may be in links.
HELD = frozenset("p pre td th h1 h2 h3 h4 h5 h6 li dd dt".split())
PROSE, LINKED = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup".split()), 0.5


def _is_cut(tag: str, attributes: str) -> tuple[int, bool]:
    """Whether the element goes with all it holds (1: unless it holds the content; 2; 3: also if it does); whether its names speak for it."""
    if tag in CUT:
        return 2, False
    form = int(tag == "form")
    if not attributes or tag in ("html", "body"):
        return form, False
    names = ""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES_CUT) or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return 2, False
        if key in ("class", "id"):
            names += f" {value}"
    cut = form
    for name in names.split() if tag not in ("article", "main") else ():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] not in OTHERS and not WORDS_CUT.isdisjoint(words) and all(w in WORDS_CUT or w in FILLERS for w in words):
            cut = max(cut, 3 if not WORDS_GONE.isdisjoint(words) else 1)
    return cut, bool(GOOD.search(names))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tags, kinds, parents, cut, soft, points = [""], [""], [-1], [False], [0], [0.0]  # of elements; the first holds the page
    blocks: list[list] = []  # element, its text, characters in links
    open_ = [0]
    links = 0
    fresh = True
    at, end = 0, len(page)

    def text(a: int, z: int) -> None:
        nonlocal fresh
        here = open_[-1]
        if a >= z or cut[here]:
            return
        raw = page[a:z]
        if fresh:
            if raw.isspace():
                return
            while here and tags[here] not in BLOCK:
                here = parents[here]
            blocks.append([here, [], 0])
            fresh = False
        blocks[-1][1].append(raw)
        if links:
            blocks[-1][2] += len(raw.strip())

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            fresh = True
        elif tag == "br" and not fresh:
            blocks[-1][1].append(" ")
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if tags[open_[k]] == tag:
                    links -= sum(tags[x] == "a" for x in open_[k:])
                    del open_[k:]
                    break
                if tag not in WALLS and tags[open_[k]] in WALLS:
                    break
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if ends:
            for k in range(len(open_) - 1, 0, -1):
                t = tags[open_[k]]
                if t in ends:
                    links -= sum(tags[x] == "a" for x in open_[k:])
                    del open_[k:]
                    break
                if t in WALLS and not (t in ("td", "th") and tag == "tr"):
                    break
        if tag in VOID or SELF_CLOSED.search(m[3]) and tag not in BLOCK and tag not in RAW:
            continue
        gone, good = _is_cut(tag, m[3])
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        tags.append(tag)
        kinds.append(tag + " ".join(sorted(x.lower() for found in CLASS.findall(m[3]) for x in "".join(found).split())) if m[3] else tag)
        parents.append(open_[-1])
        cut.append(cut[open_[-1]] or gone == 2)
        soft.append(gone if gone != 2 else 0)
        points.append(5.0 * (tag not in ("", "html", "body") and tag in BLOCK) + 25.0 * good)
        open_.append(len(tags) - 1)
        links += tag == "a"

    lines = [SPACES.sub(" ", html.unescape("".join(parts))).strip() for _, parts, _ in blocks]
    _spare(tags, parents, soft, [(e, len(line) - min(n, len(line))) for (e, _, n), line in zip(blocks, lines, strict=True)])
    for i in range(1, len(tags)):  # parents come first
        cut[i] = cut[i] or bool(soft[i]) or cut[parents[i]]
    size, linked, has = [0] * len(tags), [0] * len(tags), [False] * len(tags)
    for (element, _, in_links), line in zip(blocks, lines, strict=True):
        if not line or cut[element]:
            continue
        gain = (len(line) >= 25) + line.count(",") + min(len(line) / 100, 3.0)
        holder = parents[element] if tags[element] in HELD and element else element
        for share in (1.0, 0.5):
            if holder < 0:
                break
            points[holder] += share * gain
            has[holder] = True
            holder = parents[holder]
        up = element
        while up >= 0:
            size[up] += len(line)
            linked[up] += in_links
            up = parents[up]
    value = [p * (1 - min(1.0, n / s)) if h and s else 0.0 for p, n, s, h in zip(points, linked, size, has, strict=True)]
    if not any(value):
        return ""
    best = max(range(len(tags)), key=lambda i: (value[i], -i))
    most = value[:]  # in an element, with all it holds
    children: dict[int, list[int]] = {}
    for i in range(len(tags) - 1, 0, -1):
        most[parents[i]] = max(most[parents[i]], most[i])
        children.setdefault(parents[i], []).append(i)
    plain = lambda i: size[i] and linked[i] <= LINKED * size[i]
    enough = max(10.0, 0.2 * value[best])
    kept = {best}
    for i in children.get(parents[best], ()):
        if not cut[i] and (value[i] >= enough or plain(i) and (tags[i] in PROSE or kinds[i] == kinds[best])):
            kept.add(i)
    up = parents[best]
    while up > 0 and tags[up] not in ("html", "body"):
        kept |= {i for i in children[parents[up]] if i != up and not cut[i] and kinds[i] == kinds[up] and most[i] >= enough and plain(i)}
        up = parents[up]
    inside = [False] * len(tags)
    for i in range(len(tags)):
        inside[i] = i in kept or (i > 0 and inside[parents[i]])
    beside = lambda element, line, in_links: best > 0 and element == parents[best] and in_links <= LINKED * len(line)
    return "\n".join(line for (element, _, n), line in zip(blocks, lines, strict=True) if line and not cut[element] and (inside[element] or beside(element, line, n)))


def _spare(tags: list[str], parents: list[int], soft: list[int], texts: list[tuple[int, int]]) -> None:
    """Clears the marks of elements that hold the content. texts: element and characters outside links of each block."""
    if not any(x == 1 for x in soft):
        return
    gone = [False] * len(tags)  # within what goes for sure
    for i in range(1, len(tags)):
        gone[i] = gone[parents[i]] or soft[i] == 3
    held, holds = [0] * len(tags), [False] * len(tags)
    for element, n in texts:
        if not gone[element]:
            held[element] += n
    for i in range(len(tags) - 1, 0, -1):
        held[parents[i]] += held[i]
        holds[parents[i]] = holds[parents[i]] or holds[i] or (tags[i] in ("article", "main") and not gone[i])
    for i in range(1, len(tags)):
        if soft[i] == 1 and (holds[i] or held[i] > 0.6 * held[0]):
            soft[i] = 0


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep columns, text): a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, column="__html"):
            texts = pa.array([main_text(x) for x in b.column(b.schema.get_field_index("__html")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [texts], [*keep, "__text"])

    common.small_batches(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).alias("__html"))
    return rows.mapInArrow(run, f"{schema}, __text string").withColumnRenamed("__text", "text")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
