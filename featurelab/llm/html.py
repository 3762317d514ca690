"""Main-text extraction from HTML pages.

A page is cut into text blocks by one scan over its tags.  Blocks inside
elements that are not content by their role (navigation, page header and
footer, asides, forms, scripts, styles, and elements whose class or id names
adverts, notices, reader comments and the like) are left out.  If the page marks
its main part (``article`` or ``main``), the blocks in it are its lines, else
all blocks are.  A line is sure if it lies in the main part; it is in doubt on a
page without one, and in an element whose class or id only contains such a name
(``related-work``, ``notice-of-intent``).

Every page is then differenced: within each host pages are ordered by URL path,
each page is paired with its nearest neighbours on both sides, the lines are
aligned by longest common subsequence, and lines in doubt that are shared with a
neighbour are deleted as template.  Neighbours meet by position in a
range-sorted order, so a host of any size spreads over many tasks.  A page
without a main part all of whose lines are shared (a copy of its neighbour)
keeps them.

Differencing alone cannot meet the contract where the template holds random
text per page, or where neighbouring articles share passages; see the README
for figures.

Defined results: null or empty html gives an empty text; text outside any tag
counts as a block; an unclosed script or style runs to the end of the page; an
element that is left out ends as in HTML also without an end tag (a paragraph
at the next block, list items, terms, cells, rows and options at the next one,
any at the end of an element around it), and if it has no end tag, where an
``article``, ``main`` or ``h1`` starts; a null or unparsable url is a host of its own kind ('' as host
and path); repeated rows are extracted one by one, none is a neighbour of its copies; an empty table gives an
empty result; extra and clashing columns are not read.
"""
from __future__ import annotations

import html as _html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.position import with_position
from . import common

# a quote opens a value only right after an equals sign; one that is never closed is an ordinary character
_VALUE = r"""\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|["']?)"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>=]|={_VALUE})*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s/>=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|["']?))?""")
_SPACE = re.compile(r"\s+")

# fixed values: element kinds of the HTML standard
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small "
                    "span strike strong sub sup time tt u var wbr img br td th".split())
_DROP = frozenset("nav footer aside form dialog menu select button svg math canvas object audio video map fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status".split())
# fixed values: words of class and id names that mark what is not the article
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
                   "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup "
                   "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidenav footer header masthead "
                   "toolbar comment comments disqus respond replies share sharing social related recommended widget login search".split())
_REPLIES = frozenset("comment comments disqus respond replies".split())
# fixed values: words that add no meaning of their own to such a name (ad-slot, site-footer)
_NEUTRAL = frozenset("area article articles author bar block body bottom box btn button buttons child col column container content depth even form "
                     "global group icon icons id inner item items label left link links list main meta module node odd outer page panel parent "
                     "post posts reader readers right row section single site slot text thread title top unit user users wrap wrapper".split())
_WORD = re.compile(r"[a-z]+")
#: up to so many deleted lines (4 bytes each, and some per page) are broadcast to the pages, beyond it they are joined
BROADCAST_LINES = 4_000_000
#: how a class or id judges an element: content, in doubt, left out
_KEEP, _DOUBT, _LEAVE = range(3)
# fixed values: which open elements a start tag ends (HTML standard, optional tags)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
                                "footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_P_SCOPE = frozenset("applet button caption marquee object table td th".split())
_ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
_ROWS = {"td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["td", "th", "tr"])}
_ROWS |= dict.fromkeys(("thead", "tbody", "tfoot"), frozenset("caption colgroup td th tr thead tbody tfoot".split()))
_LISTS = frozenset(["ol", "ul", "menu", "dir", "dl"])


def _after_start(stack: list[str], tag: str) -> int:
    """How many of the open elements ``stack`` stay open when ``tag`` starts."""
    n = len(stack)
    if tag in _ITEMS:
        for i in range(n - 1, -1, -1):
            if stack[i] in _ITEMS[tag]:
                n = i
            elif stack[i] not in _INLINE and stack[i] not in ("address", "div", "p"):
                break
    elif tag in _ROWS:
        for i in range(n - 1, -1, -1):
            if stack[i] == "table":
                break
            if stack[i] in _ROWS[tag]:
                n = i
    elif tag in _HEADINGS and n and stack[-1] in _HEADINGS:
        n -= 1
    if tag in _ENDS_P and "p" in stack:
        for i in range(n - 1, -1, -1):
            if stack[i] == "p":
                return i
            if stack[i] in _P_SCOPE:
                break
    return n


def _after_end(stack: list[str], tag: str) -> int:
    """How many of the open elements ``stack`` stay open after the end tag ``tag``; all if it ends none."""
    for i in range(len(stack) - 1, -1, -1):
        x = stack[i]
        if x == tag or (tag in _HEADINGS and x in _HEADINGS):
            return i
        if tag in _ROWS or tag == "caption":
            if x == "table":
                break
        elif (tag in _INLINE and (x not in _INLINE or x in _ROWS)) or (tag in _ITEMS and x in _LISTS):
            break
    return len(stack)


def _has_end(page: str, pos: int, tag: str) -> bool:
    """Whether an element ``tag`` that is open at ``pos`` has an end tag of its own after it."""
    inner = 0
    for m in re.compile(rf"<(/?){tag}\b", re.I).finditer(page, pos):
        inner += -1 if m.group(1) else 1
        if inner < 0:
            return True
    return False


def _name_judges(name: str) -> int:
    """What one class or id says: it is, or it only contains, a word for what is not the article."""
    parts = _WORD.findall(name)
    if _NAMES.isdisjoint(parts):
        return _KEEP
    return _LEAVE if all(x in _NAMES or x in _NEUTRAL for x in parts) else _DOUBT


def _judge(tag: str, attrs: str, in_main: bool) -> int:
    """Whether an element is content."""
    if tag in _DROP or (tag == "header" and not in_main):
        return _LEAVE
    if not attrs or tag in ("html", "body"):
        return _KEEP
    verdict = _KEEP
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "role" and value in _ROLES) or (name == "aria-hidden" and value == "true"):
            return _LEAVE if tag not in ("main", "article") else verdict
        if name in ("class", "id") and not (in_main and tag in ("header", "h1", "h2", "h3")):
            for word in value.split():
                said = _name_judges(word)
                if tag in ("main", "article") and not in_main and (said == _DOUBT or _REPLIES.isdisjoint(_WORD.findall(word))):
                    said = _KEEP  # the main part itself, whatever else it is called
                verdict = max(verdict, said)
    return verdict


def judged_blocks(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """Text blocks of a page in order, each with whether it is in doubt, and whether the page marks its main part.

    The blocks are those of the main part if that has text, else all.
    """
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    depth = 0  # inside article / main
    stack: list[str] = []  # open elements, without html and body
    skip = -1  # place in the stack of the element that is left out
    ends = False  # it is known to have an end tag
    doubt = -1  # place in the stack of the outermost element in doubt
    pos, n = 0, len(page)

    def flush():
        if text:
            t = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            if t:
                out.append((t, depth > 0, doubt >= 0))
            text.clear()

    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            if skip < 0 and not m.group().startswith(("<!", "<?")):
                text.append(m.group())
            continue
        tag, closing = tag.lower(), bool(m["end"])
        if tag in _RAW:
            if not closing and not m.group().endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        opens = not closing and tag not in _VOID and tag not in ("html", "body") and not m.group().endswith("/>")
        left = _after_end(stack, tag) if closing else _after_start(stack, tag)
        if skip >= 0:
            if left > skip:
                main = not closing and tag in ("article", "main", "h1")
                ends = ends or (main and _has_end(page, m.start(), stack[skip]))
                if ends or not main:
                    del stack[left:]
                    if opens:
                        stack.append(tag)
                    continue
                left = skip
            own = closing and left == skip
            skip = -1
            if own:
                del stack[left:]
                continue
        del stack[left:]
        if opens:
            stack.append(tag)
        if tag not in _INLINE or left <= doubt:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if left <= doubt:
            doubt = -1
        verdict = _judge(tag, m["attrs"], depth > 0) if opens else _KEEP
        if verdict == _LEAVE:
            flush()
            skip, ends = len(stack) - 1, False
        elif tag in ("article", "main"):
            depth = max(0, depth - 1) if closing else depth + 1
        elif verdict == _DOUBT and doubt < 0 and tag not in _INLINE:
            doubt = len(stack) - 1
    flush()
    marked = any(inside for _, inside, _ in out)
    return [(t, unsure or not marked) for t, inside, unsure in out if inside or not marked], marked


def blocks(page: str) -> list[str]:
    """Text blocks of a page without regard to its neighbours."""
    return [t for t, _ in judged_blocks(page)[0]]


def shared_lines(a: list[int], b: list[int]) -> np.ndarray:
    """Which lines of ``a`` lie on a longest common subsequence with ``b`` (lines as hashes)."""
    mark = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    mark[:lo] = True
    if hi:
        mark[-hi:] = True
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    # Hunt-Szymanski: longest increasing chain of match points, memory in the number of lines shared
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    tops: list[int] = []
    nodes: list[tuple] = []
    for i, v in enumerate(x):
        for j in reversed(places.get(v, ())):
            k = int(np.searchsorted(tops, j)) if len(tops) > 32 else next((t for t, u in enumerate(tops) if u >= j), len(tops))
            node = (i, nodes[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                nodes.append(node)
            else:
                tops[k] = j
                nodes[k] = node
    node = nodes[-1] if nodes else None
    while node:
        mark[lo + node[0]] = True
        node = node[1]
    return mark


def _url_key(url) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return "", ""


def _source(pages: DataFrame, id_column: str) -> DataFrame:
    """``page_id, url, html, page_hash``; rows equal in these are one page, extracted for each of them."""
    html = F.col("html").cast("string")
    return pages.select(F.col(id_column).alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.xxhash64(F.coalesce(html, F.lit(""))).alias("page_hash"))


def parsed_pages(source: DataFrame) -> DataFrame:
    """``page_id, url, page_hash, host, path, marked, mine, doubt`` of every page: its lines only as hashes."""

    def run(it):
        for rb in it:
            host, path, marked, lines, doubt = [], [], [], [], []
            for url, page in zip(rb.column(1), rb.column(2)):
                h, p = _url_key(url.as_py())
                found, mark = judged_blocks(page.as_py() or "")
                host.append(h)
                path.append(p)
                marked.append(mark)
                lines.append([t for t, _ in found])
                doubt.append([d for _, d in found])
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), rb.column(3), pa.array(host, pa.string()), pa.array(path, pa.string()),
                 pa.array(marked, pa.bool_()), pa.array(lines, pa.list_(pa.string())), pa.array(doubt, pa.list_(pa.bool_()))],
                names=["page_id", "url", "page_hash", "host", "path", "marked", "lines", "doubt"])

    kind = source.schema["page_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"page_id {kind}, url string, page_hash long, host string, path string, marked boolean, "
                                 "lines array<string>, doubt array<boolean>")
    return out.withColumn("mine", F.transform("lines", lambda x: F.xxhash64(x))).drop("lines")


def shared_with_neighbours(parsed: DataFrame) -> DataFrame:
    """``page_id, url, page_hash, gone``: the numbers of the lines in doubt that a page shares with its nearest pages of the
    host, for the pages that have some."""
    key = ["page_id", "url", "page_hash"]
    slim = common.stage(parsed.dropDuplicates(key), "parsed-pages")
    slim = with_position(slim, ["host", "path", *key], "pos").drop("path")
    near = slim.select(F.col("host").alias("h"), F.col("pos").alias("p"), F.col("mine").alias("other"))
    both = slim
    for step, name in ((1, "before"), (-1, "after")):
        side = near.select("h", (F.col("p") + step).alias("p"), F.col("other").alias(name))
        both = both.join(side, (both["pos"] == side["p"]) & (both["host"] == side["h"]), "left").drop("h", "p")

    def align(it):
        for rb in it:
            out = []
            for mine, before, after, marked, doubt in zip(*(c.to_pylist() for c in rb.columns[3:])):
                shared = np.zeros(len(mine), bool)
                for other in (before, after):
                    if other is not None:
                        shared |= shared_lines(mine, other)
                gone = shared & np.asarray(doubt, bool)
                out.append([] if gone.all() and not marked else np.flatnonzero(gone).tolist())
            rows = pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=[*key, "gone"])
            yield rows.filter(pa.array([len(g) > 0 for g in out], pa.bool_()))

    kind = slim.schema["page_id"].dataType.simpleString()
    return both.select(*key, "mine", "before", "after", "marked", "doubt") \
        .mapInArrow(align, f"page_id {kind}, url string, page_hash long, gone array<int>")


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """``page_id, url, text`` of every page row.

    Pages are parsed once for the hashes of their lines, which meet those of the
    neighbours, and once for the text, so no text is written or exchanged unless
    so many pages lose lines that their list is no small table.
    """
    common.prepare(pages.sparkSession)
    source = _source(pages, id_column)
    gone = common.stage(shared_with_neighbours(parsed_pages(source)), "shared-lines")
    small = gone.agg(F.coalesce(F.sum(F.size("gone") + 16), F.lit(0))).first()[0] <= BROADCAST_LINES
    gone = gone.withColumnsRenamed({"page_id": "p", "url": "u", "page_hash": "h"})
    rows = source.join(F.broadcast(gone) if small else gone, F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u"))
                       & (F.col("page_hash") == F.col("h")), "left").select("page_id", "url", "html", "gone")

    def run(it):
        for rb in it:
            text = []
            for page, gone in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist()):
                lines = blocks(page or "")
                drop = set(gone or ())
                text.append("\n".join(t for i, t in enumerate(lines) if i not in drop))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string")
