"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text with their root-to-leaf path of elements.  For
each path the lengths and the punctuation of its blocks are summed and divided by their
number; the two ratios are fused (text length, times punctuation, less the part in links)
and smoothed over neighbouring blocks, and the smoothed score is lowered where classes and
ids say that an element is a menu, notice, advert, form or comment.  Blocks above a
threshold are content.  They choose the article: the ``article`` or ``main`` that holds
most of them or, without one, the smallest element around them all.  Its blocks are the
text: those above the threshold, and short ones (headings, items, cells) that nothing
speaks against.  Class words alone drop nothing; elements that hold no text of an article
by their meaning (nav, form, script, a role, hidden) do.

Memory is linear in the page: a path is the number of its parent path and a name.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML.
BLOCKS = frozenset(
    """address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th
    thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
SKIPPED = frozenset(
    "head script style noscript template svg iframe object embed canvas audio video select option button textarea input form nav footer aside dialog menu title datalist".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_P_INSIDE = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "col", "colgroup", "html", "head", "body", "title", "option", "optgroup", "noscript", "legend"}
# Words in class and id attributes of what surrounds an article.
AROUND = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs header masthead
    footer comment comments commentlist respond disqus replies reply share sharing social related recommended recommendations widget widgets pagination pager
    toolbar login search hidden skip discussion responses feedback advertorial announcement announcements teaser teasers colophon topbar billboard
    leaderboard skyscraper trending""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are a piece of text, not a box around others.
TEXTS = HEADINGS | frozenset("p blockquote li dd dt td th pre figure figcaption caption".split())
# Words that on a piece of text inside an article mean an advert or a notice.
PLAIN = frozenset("ad ads advert adverts advertisement advertising notice notices sponsor sponsored promo promotion cookie cookies newsletter subscribe signup share sharing".split())
# Words that say nothing in a name with one of the above.
FILLERS = frozenset(
    """area article articles bar body block bottom box button buttons col column container content count entry form group icon icons inline inner item items left link
    links list main media module page panel post posts primary reader readers right row secondary section side site slot social text thread title top unit user users
    wrap wrapper""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")
THRESHOLD = 0.25  # of the best score
STRONG, PLAINLY, WEAK = 0.05, 0.2, 0.5  # what class words leave of a score
STORY = 100  # characters without such words that are a story of their own


class _Element:
    __slots__ = ("tag", "path", "parent", "around", "weight", "holder", "number", "last")

    def __init__(self, tag: str, attrs: dict, parent: "_Element | None", number: int, paths: dict):
        self.tag, self.parent, self.number, self.last = tag, parent, number, None
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        hidden = attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or "hidden" in attrs
        inside = parent is not None and parent.holder is not None
        self.around = (
            (parent is not None and parent.around)
            or tag in SKIPPED
            or (tag == "header" and not inside)
            or attrs.get("role", "").lower() in ROLES
            or hidden
        )
        self.weight = (parent.weight if parent else 1.0) * (_weight(tag, attrs, inside) if names != " " else 1.0)
        is_holder = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
        self.holder = self if is_holder and not self.around and self.weight == 1.0 else (parent.holder if parent else None)
        self.path = paths.setdefault((parent.path if parent else -1, tag, tuple(sorted(set(_WORD.findall(names))))), len(paths))


def _weight(tag: str, attrs: dict, inside: bool) -> float:
    """What class and id leave of an element's score.  Ids of headings, and of sections in
    an article, are slugs of their titles; other ids in an article count whole."""
    classes, own = attrs.get("class", "").lower(), attrs.get("id", "").lower()
    parts = set(_WORD.findall(f"{classes} {own}"))
    telling = AROUND - ({"header", "hidden"} if parts & {"article", "entry", "post"} or tag == "body" else set())
    if tag in ("html", "body"):
        return 1.0
    if tag in TEXTS:
        return PLAINLY if (PLAIN if inside else telling) & set(classes.split()) else 1.0
    names = classes.split() if not (inside and tag == "section" and not classes) else []
    if not inside:
        return STRONG if telling & parts else 1.0
    if own in telling and tag != "section" or any(n in telling for n in names):
        return STRONG
    if tag == "section":
        return 1.0
    found = 1.0
    for words in map(set, map(_WORD.findall, names)):
        if telling & words:
            found = min(found, STRONG if words <= telling | FILLERS else WEAK)
    return found


def _attributes(text: str) -> dict:
    found = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if "=" in text else {}
    if "hidden" in text.lower().split():
        found["hidden"] = ""
    return found


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(element, text, characters in links) of each block of a page, in page order."""
    out: list = []
    paths: dict = {}
    root = _Element("html", {}, None, 0, paths)
    stack, links, parts, linked, number, open_ = [root], 0, [], 0, 0, Counter(["html"])
    within = 0  # elements around the open link; it ends with the last of them

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = _html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    def close(tags: set, stops: set) -> None:
        nonlocal links
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                for e in stack[k:]:
                    e.last = number
                    open_[e.tag] -= 1
                del stack[k:]
                links = 0 if len(stack) < within else links
                return
            if stack[k].tag in stops:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag cut off at the end
                break
            add("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "p" and not open_["p"]:
                flush()
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCKS or tag in SKIPPED:
                if tag not in ("html", "body"):
                    close({tag}, {"article", "td", "th", "body"} - {tag})
                flush()
            continue
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            close_gt = page.find(">", end.end())
            at = n if close_gt < 0 else close_gt + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":  # one that leads nowhere is no link, and no link holds another
            links, within = int(bool(_HREF.search(m[3]))), len(stack)
            continue
        if tag not in BLOCKS and tag not in SKIPPED:
            continue
        if tag in NO_P_INSIDE:
            close({"p"}, {"td", "th", "article", "section", "div", "li", "body", "blockquote", "form", "aside", "nav", "footer", "header", "main"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        flush()
        if tag in VOID or m[3].rstrip().endswith("/") and tag in SKIPPED:
            continue
        if tag in ("html", "body") and tag == "html":
            continue
        number += 1
        open_[tag] += 1
        stack.append(_Element(tag, _attributes(m[3]), stack[-1], number, paths))
    flush()
    for e in stack:
        e.last = number
    return out


def path_scores(found: list) -> list[float]:
    """The score of each block: the fused ratio of its path, smoothed over the blocks next
    to it (by their weight) and lowered by its own; zero for what surrounds an article."""
    sums: dict = {}
    for element, text, linked in found:
        s = sums.setdefault(element.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += linked
    fused = {path: chars / n * (1 + marks / n) * (1 - linked / chars) for path, (n, chars, marks, linked) in sums.items()}
    kernel = [exp(-(d * d) / 2) for d in (-1, 0, 1)]
    smooth = []
    for i, (element, _, _) in enumerate(found):
        if element.around:
            smooth.append(0.0)
            continue
        near = [(kernel[d + 1], fused[found[i + d][0].path] * (found[i + d][0].weight if d else 1.0)) for d in (-1, 0, 1) if 0 <= i + d < len(found) and not found[i + d][0].around]
        smooth.append(element.weight * sum(k * x for k, x in near) / sum(k for k, _ in near))
    return smooth


def _holds(element: _Element, number: int) -> bool:
    return element.number <= number <= element.last


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a blank line; empty if there are none."""
    found = blocks(page or "")
    scores = path_scores(found)
    if max(scores, default=0.0) <= 0:  # nothing but links: length alone
        scores = [0.0 if element.around else len(text) * element.weight for element, text, _ in found]
    unmarked = [text for element, text, _ in found if element.weight == 1.0 and not element.around]
    if sum(map(len, unmarked)) >= STORY and sum(len(_PUNCTUATION.findall(t)) for t in unmarked) > 1:  # comments may be longer than the story
        scores = [0.0 if element.weight <= STRONG else score for (element, _, _), score in zip(found, scores)]
    best = max(scores, default=0.0)
    if best <= 0:
        return ""
    content = [i for i, s in enumerate(scores) if s >= THRESHOLD * best]
    held: dict = {}
    for i in content:
        if (holder := found[i][0].holder) is not None:
            held[holder] = held.get(holder, 0) + len(found[i][1])
    if held:
        inside = max(held, key=held.get)
    else:
        inside = found[content[0]][0]
        numbers = [found[i][0].number for i in content]
        while not (_holds(inside, min(numbers)) and _holds(inside, max(numbers))):
            inside = inside.parent
        if len(content) == 1 and inside.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td") and inside.parent is not None:
            inside = inside.parent
    sums: dict = {}
    for element, text, linked in found:
        s = sums.setdefault(element.path, [0, 0])
        s[0] += linked
        s[1] += len(text)
    kept = []
    for (element, text, linked), score in zip(found, scores):
        if element.around or not _holds(inside, element.number):
            continue
        path_linked, path_chars = sums[element.path]
        in_links = not held and linked > 0.5 * len(text) and path_linked > 0.5 * path_chars
        if score >= THRESHOLD * best or (element.weight == 1.0 and not in_links):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all but the html by default) with the main text of each page.
    Null and empty pages, and pages without an article, have an empty text."""
    carried = [c for c in (carry or pages.columns) if c not in (into, html_col)]
    schema = T.StructType([*pages.select(*carried).schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*carried, into])

    return pages.select(*carried, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)


def op7_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and its length for every page; null and empty pages have an empty text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, carry=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
