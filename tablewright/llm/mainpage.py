"""Main text of web pages by differencing with the page of the nearest URL (operator 4).

Markup says much already: articles are marked as such, and menus, forms or adverts too. What it leaves open is decided by
comparison: pages of a host are ordered by URL path, each is aligned with its nearest neighbour by a longest common
subsequence of text lines, and the lines that both share, the template, are deleted.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns
from tablewright.operators.rowindex import dense_index
from tablewright.session import stored

# Elements whose content is never shown as text, and whose end alone ends it.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "object", "canvas", "audio", "video", "select"}
# Those of them that hold plain text only, so that without an end they go on to the end of the page.
PLAIN = {"script", "style", "textarea", "title"}
# Elements around the main text that are no part of it.
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "input", "label", "fieldset", "datalist"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that begin a new block of text.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Words in class, id or role that mark what surrounds the main text.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus discussion widget toolbar pagination pager complementary contentinfo search".split()
)
HEADER_MARKS = {"header", "topbar"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

_BLOCK = re.compile(f"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\\s/>])", re.I)

MAIN_LINE, OPEN_LINE, FRAME_LINE = 0, 1, 2
_SALTS = 16


def _framed(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is no part of the main text. An article's own header, with its title, is."""
    if name in FRAME:
        return not (name == "header" and in_main)
    if not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    marks = {w for value in _MARK.findall(attributes) for w in re.split(r"[^a-z]+", value.lower())}
    return bool(marks & MARKS or not in_main and marks & HEADER_MARKS) and name not in ("html", "body")


def text_lines(page: str) -> list[tuple[str, int]]:
    """Blocks of text in page order, each as one line, with what markup says of it.

    ``MAIN_LINE`` lies in an article or main element, ``FRAME_LINE`` in something around it, ``OPEN_LINE`` in neither.
    """
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with the kind of what they hold
    kind, at = OPEN_LINE, 0

    def end_block() -> None:
        line = " ".join("".join(parts).split())
        if line:
            lines.append((line, kind))
        parts.clear()

    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1))
        if name in RAW and not closing:
            parts.append(" ")
            if name in ("svg", "math") and (m.group(3) or "").endswith("/"):
                continue
            end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at)
            if end is None and name not in PLAIN:
                block = _BLOCK.search(page, at)
                at = block.start() if block else len(page)
            else:
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            end_block()
        elif name == "br":
            parts.append(" ")
        if name in VOID or (m.group(3) or "").rstrip().endswith("/"):
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
        else:
            if name in BLOCKS and stack and stack[-1][0] in ("p", "li", "td", "th", "dt", "dd") and (stack[-1][0] == name or stack[-1][0] == "p"):
                stack.pop()
            outer = inner = stack[-1][1] if stack else OPEN_LINE
            if outer != FRAME_LINE:
                inner = FRAME_LINE if _framed(name, m.group(3) or "", outer == MAIN_LINE) else MAIN_LINE if name in MAIN else outer
            stack.append((name, inner))
        kind = stack[-1][1] if stack else OPEN_LINE
    if at < len(page):
        parts.append(entities.unescape(page[at:]))
    end_block()
    return lines


def shared_lines(mine: np.ndarray, other: np.ndarray) -> set[int]:
    """Places in ``mine`` that a longest common subsequence with ``other`` covers (Hunt and Szymanski 1977).

    Equal beginnings and ends are taken first; among equally long ones the first found wins.
    """
    n = min(len(mine), len(other))
    head = int(np.argmin(np.append(mine[:n] == other[:n], False)))
    tail = int(np.argmin(np.append(mine[::-1][: n - head] == other[::-1][: n - head], False)))
    taken = {*range(head), *range(len(mine) - tail, len(mine))}
    places: dict[int, list[int]] = {}
    for j in range(len(other) - tail - 1, head - 1, -1):
        places.setdefault(int(other[j]), []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(head, len(mine) - tail):
        for j in places.get(int(mine[i]), ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link is not None:
        taken.add(link[0])
        link = link[1]
    return taken


def _url_part(url: Column, part: str) -> Column:
    pattern = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)"
    return F.lower(F.regexp_extract(url, pattern, 1)) if part == "host" else F.regexp_extract(url, pattern, 2)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: ``page_id``, ``url``, ``text``, ``n_chars``, ``n_template`` (lines deleted as shared).

    Lines are blocks of text with character references decoded and white space turned into single blanks. If a page has an article or main
    element, its text is that element's lines; else it is the lines outside of menus, forms and the like that the nearest
    page of the host doesn't share. Nearest: the neighbour in the order of (path, page id, row) with the longer common beginning of the
    path; the one before wins ties. Pages of a host with the very same lines are taken as one, the first of them, and all get its
    verdict; a page without host or whose host has no other lines keeps its text. A null html counts as empty; an empty table gives no rows.
    """

    def lines(texts: pa.Array) -> list[pa.Array]:
        out, hashes, open_ = [], [], []
        for page in texts.to_pylist():
            found = text_lines(page or "")
            kinds = [k for _, k in found]
            decided = MAIN_LINE in kinds
            out.append([t for t, k in found if k == (MAIN_LINE if decided else OPEN_LINE)])
            hashes.append([_hash(t) for t, _ in found])
            open_.append([] if decided else [i for i, k in enumerate(kinds) if k == OPEN_LINE])
        return [pa.array(out, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(open_, pa.list_(pa.int32()))]

    source = pages.select(column(page_id).alias("page_id"), column(url).cast("string").alias("url"), column(html).cast("string").alias("html"))
    parsed = append_columns(source, ["html"], "lines array<string>, hashes array<long>, open array<int>", lines).drop("html")
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()))
    decided = parsed.where("size(open) = 0").withColumn("n_template", F.lit(0)).withColumn("text", F.array_join("lines", "\n"))

    # Pages of a host with the same lines are one page to its neighbours; the first of them stands for all.
    address = F.coalesce("url", F.lit(""))
    narrow = parsed.select("row", _url_part(address, "host").alias("host"), _url_part(address, "path").alias("path"), "page_id", "hashes", "open")
    narrow = narrow.withColumn("same", F.xxhash64("host", "hashes"))
    first = F.min(F.struct("path", "page_id", "row"))["row"].alias("row")
    firsts = stored(narrow.groupBy("same").agg(first, F.count("*").alias("copies"), F.max(F.size("open")).alias("most_open")))

    # Neighbours by place in one order of these pages: joins on a unique number, so a host may have any number of pages.
    distinct = narrow.drop("open", "same").join(firsts, "row")
    placed = stored(dense_index(distinct, ["host", "path", "page_id", "row"], "place"))
    undecided = placed.where("most_open > 0")
    for side, step in (("before", 1), ("after", -1)):
        near = placed.select((F.col("place") + step).alias("place"), F.col("host").alias(f"{side}_host"), F.col("path").alias(f"{side}_path"), F.col("hashes").alias(f"{side}_hashes"))
        undecided = undecided.join(near, "place", "left")

    def template(paths: pa.Array, hosts: pa.Array, hashes: pa.Array, *sides: pa.Array) -> list[pa.Array]:
        out = []
        for path, host, mine, *near in zip(*[x.to_pylist() for x in (paths, hosts, hashes, *sides)], strict=True):
            found = [(common_length(path, p), h) for other, p, h in (near[:3], near[3:]) if host and other == host]
            best = max(found, key=lambda x: x[0], default=None)
            covered = shared_lines(np.array(mine, np.int64), np.array(best[1], np.int64)) if best else set()
            out.append([i in covered for i in range(len(mine))])
        return [pa.array(out, pa.list_(pa.bool_()))]

    read = ["path", "host", "hashes", *[f"{s}_{c}" for s in ("before", "after") for c in ("host", "path", "hashes")]]
    verdict = stored(append_columns(undecided, read, "covered array<boolean>", template).select("row", "same", "copies", "covered"))

    # Copies take the verdict of their first; salts deal out a page that is repeated very often.
    copies = narrow.where("size(open) > 0").select("row", "same").join(verdict.select("row"), "row", "left_anti").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(_SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt")
    repeated = verdict.where("copies > 1").select("same", "covered", salts)
    verdict = verdict.select("row", "covered").unionByName(copies.join(repeated, ["same", "salt"]).select("row", "covered"))
    shared = F.transform("open", lambda i: F.get("covered", i))
    rest = parsed.where("size(open) > 0").join(verdict, "row").withColumn("shared", shared)
    kept = F.filter(F.col("lines"), lambda _, i: ~F.get("shared", i))
    rest = rest.withColumn("n_template", F.size(F.filter("shared", lambda x: x))).withColumn("text", F.array_join(kept, "\n"))
    made = ["page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template"]
    return decided.select(*made).unionByName(rest.select(*made))


def common_length(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - (1 << 63)
