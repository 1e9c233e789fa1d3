"""Main text of web pages by the distribution of text over line blocks.

1. A page is cut into tags and text in one pass; every block element gives a line of text. Inline elements never start a
   line.
2. Each line has a weight, the length of its text. Text in links counts against the rest of its line, except in headings;
   paragraphs count PARAGRAPH times. Evidence changes weights: a line in an article container weighs SURGE at least, lines
   outside the page's containers count a tenth, lines of elements that are marked as menus, headers, footers, sidebars,
   notices, adverts, forms or comments by tag, role or a whole class or id token nothing. Text is measured before marks
   count: a mark on an element that holds most of the page's text while next to nothing is left outside it is void, and so
   is a container by class or id that holds less than half of the unmarked text.
3. Weights are summed over sliding windows of WINDOW lines, which don't reach over a container's border. A dive is a window
   that falls to nothing; between two dives the lines stay if a window among them surges to SURGE. If none does on the
   whole page, the heaviest stretch stays. So a container stays whole, and what stays elsewhere is up to the windows.
4. Of a stretch, marked lines go, and so do headings at its end outside containers (they head what follows the dive).

Character references are decoded after the markup is gone, white space in a block becomes one space, blocks are joined
by a newline. A null or empty page and one without a line of any weight give an empty text; texts of any length are handled whole; unclosed
and crossed tags are closed where HTML would close them. Beyond DEEP marks within each other an element shares the last
of them. One page is one row: no shuffle, nothing collected. Repeated
pages give repeated rows; stretches that tie for the heaviest all stay; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sgspark.llm.runtime import map_arrow

#: Lines of a window; characters of a surge; weight of paragraphs, and of lines outside the containers.
WINDOW = 3
SURGE = 80
PARAGRAPH = 8
OUTSIDE = 0.1

#: Elements whose contents aren't markup and run to their end tag, or else to the page's end; others whose contents aren't
#: text, if they have an end tag (without one, and where they close themselves, the tag alone goes).
RAW = ("script", "style", "textarea")
APART = ("noscript", "template", "iframe", "object", "svg", "select", "canvas", "audio", "video", "noembed", "noframes")
_OPEN = re.compile(rf"<({'|'.join(RAW + APART)})\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW + APART}
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>")
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul")
#: Elements that another start tag of the set closes.
CLOSES = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}
#: Elements beyond which nothing is closed so.
SCOPES = ("ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "tbody")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
PARAGRAPHS = _words("p blockquote pre")
#: Never text of a page's body.
UNSEEN = _words("head title")
MASKED = _words("nav footer aside form menu dialog")
MASKED_ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
COMMENTS = _words("comment comments disqus respond reply replies")
MASKED_NAMES = COMMENTS | _words(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login signin "
    "share sharing social related recommended recommendations widget widgets pagination pager search form copyright skip"
)
#: What may stand beside such a name in a token (site-footer, comment-list) without changing its meaning.
NEUTRAL = _words("left right top bottom main inner outer wrapper wrap container box block section area list item items region panel bar site page article post posts entry story content body primary secondary global link links col column row form text buttons icons unit slot 1 2 3 4")
#: What follows such a name without a separator (commentlist, cookiebar), and what doesn't make a mark of one that is about
#: readers' comments (comments-open).
FUSED = _words("list lists bar slot section box area banner unit wrapper container panel block thread form")
STATES = _words("open closed enabled disabled allowed count counts on off has no with")
#: Marks within marks that are told apart.
DEEP = 64
CONTAINER_TAGS = _words("article main")
CONTAINER_NAMES = _words("article content post entry story main maincontent main-content article-content article-body post-content post-body entry-content story-body page-content")


class _Element:
    """An open element: marks are the numbers of the marked elements that it is in, inside is 2 in a container by tag or
    role, 1 in one by name, header is true in a header, which only headings leave."""

    __slots__ = ("tag", "block", "marks", "inside", "link", "header", "unseen")

    def __init__(self, tag: str, block: str, marks: tuple[int, ...], inside: int, link: bool, header: bool, unseen: bool):
        self.tag, self.block, self.marks, self.inside, self.link, self.header, self.unseen = tag, block, marks, inside, link, header, unseen


class Line:
    """A block's text; plain and linked are the lengths of its text outside and inside links."""

    __slots__ = ("text", "plain", "linked", "marks", "inside", "tag")

    def __init__(self, text: str, plain: int, linked: int, marks: tuple[int, ...], inside: int, tag: str):
        self.text, self.plain, self.linked, self.marks, self.inside, self.tag = text, plain, linked, marks, inside, tag


def _named(tokens: set[str], names: frozenset[str]) -> bool:
    """Whether a token is one of the names, a name and a fused word, made of names and neutral words, or, where names hold
    those of readers' comments, a compound with one of these that doesn't state whether there are any."""
    for token in tokens:
        if token in names or any(token.endswith(f) and token[: -len(f)] in names for f in FUSED):
            return True
        parts = re.split("[-_]+", token.strip("-_"))
        if len(parts) > 1:
            if any(p in names for p in parts) and all(p in names or p in NEUTRAL for p in parts):
                return True
            if names >= COMMENTS and any(p in COMMENTS for p in parts) and STATES.isdisjoint(parts):
                return True
    return False


class _Page:
    """The lines of a page and, for each mark, whether a large text can void it."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.firm: list[bool] = []

    def opened(self, tag: str, attributes: str, up: _Element) -> _Element:
        tokens: set[str] = set()
        role, hidden = "", False
        for name, a, b, c in _ATTR.findall(attributes) if attributes else ():
            name = name.lower()
            value = a or b or c
            if name in ("class", "id"):
                tokens.update(value.lower().split())
            elif name == "role":
                role = value.lower().strip()
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
        unseen = up.unseen or hidden or tag in UNSEEN or tag == "button"
        if tag not in BLOCK:
            return _Element(tag, up.block, up.marks, up.inside, up.link or tag == "a", up.header, unseen)
        inside, header = up.inside, up.header
        masked = firm = False
        if tag in CONTAINER_TAGS or role in ("main", "article"):
            masked = firm = _named(tokens, COMMENTS) or _named(tokens, MASKED_NAMES - _words("header foot footer nav aside"))
            inside = inside if masked else 2
        elif tag not in ("html", "body"):
            by_name = _named(tokens, MASKED_NAMES - {"header"})
            masked = tag in MASKED or role in MASKED_ROLES or by_name
            firm = _named(tokens, COMMENTS) or tag in MASKED
            if not masked and (tag == "header" or _named(tokens, _words("header"))):
                masked, header = not up.inside, True
            elif not masked and tokens & CONTAINER_NAMES:
                inside = max(inside, 1)
        marks = up.marks
        if masked and len(marks) < DEEP:
            marks = (*marks, len(self.firm))
            self.firm.append(firm)
        return _Element(tag, tag, marks, inside, up.link, header, unseen)


def _markup(page: str) -> str:
    """The page without elements whose contents aren't text, comments and declarations."""
    full = page.rfind(">") + 1  # behind that no tag ends
    page, tail = page[:full], page[full:].split("<!--", 1)[0]
    parts, at, endless = [], 0, set()
    while m := _OPEN.search(page, at):
        tag = m[1].lower()
        parts.append(page[at : m.start()])
        at = m.end()
        if tag in RAW or (tag not in endless and not m[2].rstrip().endswith("/")):
            end = _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at, tail = len(page), ""
            else:
                endless.add(tag)
    return _DROP.sub("", " ".join([*parts, page[at:]])) + tail


def parsed(page: str) -> _Page:
    """The page's lines in order. Places of open elements are kept by tag, so that time grows with the page's length."""
    page = _markup(page)
    out = _Page()
    root = _Element("", "", (), 0, False, False, False)
    stack, parts = [root], []
    sizes = [0, 0]
    where = root
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def drop(i: int) -> None:
        for e in stack[i:]:
            places[e.tag].pop()
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and (not where.header or where.block in HEADINGS):
                out.lines.append(Line(text, sizes[0], sizes[1], where.marks, where.inside, where.block))
        parts = []
        sizes[:] = [0, 0]

    def add(text: str) -> None:
        nonlocal where
        top = stack[-1]
        if not text or top.unseen or (text.isspace() and not parts):
            return
        if not parts:
            where = top
        parts.append(text)
        sizes[top.link] += len(text.strip())

    at = 0
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        add(page[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if tag in BLOCK:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if close:
            if places.get(tag):
                drop(places[tag][-1])
        elif tag not in VOID:
            if tag in BLOCK:
                if blocks and stack[blocks[-1]].tag == "p":
                    drop(blocks[-1])
                if tag in CLOSES and last(CLOSES[tag]) > last(SCOPES):
                    drop(last(CLOSES[tag]))
            if not attributes.rstrip().endswith("/"):
                if tag in BLOCK:
                    blocks.append(len(stack))
                places.setdefault(tag, []).append(len(stack))
                stack.append(out.opened(tag, attributes, stack[-1]))
    add(page[at:])
    flush()
    return out


def _void_marks(page: _Page) -> set[int]:
    """Marks that don't count: their elements hold most of the page's text, and next to nothing stands outside marks. A mark
    by tag, or of comments, has to hold a container or a first-level heading as well."""
    void: set[int] = set()
    total = sum(x.plain for x in page.lines)
    while True:
        free = [x for x in page.lines if void.issuperset(x.marks)]
        if sum(x.plain for x in free) >= SURGE or any(x.inside and x.plain for x in free):
            return void
        held: dict[int, int] = {}
        good: set[int] = set()
        for x in page.lines:
            for m in x.marks:
                held[m] = held.get(m, 0) + x.plain
                if not page.firm[m] or x.inside == 2 or x.tag == "h1":
                    good.add(m)
        most = [m for m in held if m in good and m not in void and 2 * held[m] > total]
        if not most:
            return void
        void.add(min(most))


def weights(page: _Page) -> tuple[list[float], list[bool], list[bool]]:
    """Each line's weight, whether it is marked, and whether it is in a container."""
    void = _void_marks(page)
    marked = [not void.issuperset(x.marks) for x in page.lines]
    free = [x for x, m in zip(page.lines, marked, strict=True) if not m]
    least = 2 if any(x.inside == 2 for x in free) else 1
    if least == 1 and 2 * sum(x.plain + x.linked for x in free if x.inside) < sum(x.plain + x.linked for x in free):
        least = 3
    inside = [x.inside >= least for x in page.lines]
    known = any(i and not m for i, m in zip(inside, marked, strict=True))
    out = []
    for x, masked, within in zip(page.lines, marked, inside, strict=True):
        size = x.plain + x.linked if x.tag in HEADINGS else max(0, x.plain - x.linked)
        if masked:
            out.append(0.0)
        elif within:
            out.append(float(max(SURGE, x.plain + x.linked)))
        elif known:
            out.append(OUTSIDE * size)
        else:
            out.append(float(size * PARAGRAPH if x.tag in PARAGRAPHS else size))
    return out, marked, inside


def stretches(weight: list[float], inside: list[bool]) -> list[tuple[int, int]]:
    """Lines [a, b) between dives of the windows, cut to lines that weigh something, of which a window surges; if none does,
    the heaviest. A lighter weight than 1 is nothing. Windows end where ``inside`` changes."""
    n = len(weight)
    end = [n] * n
    for i in range(n - 2, -1, -1):
        end[i] = end[i + 1] if inside[i] == inside[i + 1] else i + 1
    sums = [sum(weight[i : min(i + WINDOW, end[i])]) for i in range(n)]
    found = []
    i = 0
    while i < n:
        if sums[i] < 1:
            i += 1
            continue
        first = i
        while i < n and sums[i] >= 1 and inside[i] == inside[first]:
            i += 1
        solid = [k for k in range(first, i) if weight[k] >= 1]
        if solid:
            found.append((max(sums[first:i]), sum(weight[first:i]), solid[0], solid[-1] + 1))
    surging = [x for x in found if x[0] >= SURGE]
    if not surging and found:
        most = max(x[1] for x in found)
        surging = [x for x in found if x[1] == most]
    return [x[2:] for x in surging]


def main_text(page: str | None) -> str:
    """The text between surges and dives of the page's line blocks."""
    if not page:
        return ""
    found = parsed(page)
    weight, marked, inside = weights(found)
    out = []
    for a, b in stretches(weight, inside):
        while b - a > 1 and found.lines[b - 1].tag in HEADINGS and not inside[b - 1]:
            b -= 1
        out += [x.text for x, m in zip(found.lines[a:b], marked[a:b], strict=True) if not m]
    return "\n".join(out)


def extracted(pages: DataFrame, source: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with ``text`` and its length in code points; columns of pages with these names are replaced."""
    at = pages.columns.index(source)
    kept = [i for i, c in enumerate(pages.columns) if c not in (text, n_chars)]
    schema = StructType([pages.schema[i] for i in kept] + [StructField(text, StringType()), StructField(n_chars, LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + [pa.array(texts, out.field(len(kept)).type), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return map_arrow(pages, run, schema)
