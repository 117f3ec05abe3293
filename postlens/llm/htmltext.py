"""Main text of web pages by removing what recurs on their site.

Every block element's subtree (its exact markup, white space collapsed) is hashed
with the page's host. Spark counts, for each such hash, the different pages of the
host that hold it, and subtrees that recur on many pages are deleted. Pages that are
copies of one another count once, so copies do not turn articles into templates. What
exact counts cannot tell (a menu with other words on each page, a host of few pages) falls
to elements whose tag, role, id or class says that they are not the article, and, where
a page marks its article (article, main), to what lies outside of it. Two kinds of
elements only count as templates if the path of tags and classes that leads to them
recurs on many pages of the host: those whose class merely begins or ends with a telling
word, inside the article, and those outside of it whose whole text is links. Headings
and plain text blocks are never cut by their names, nor anything by a part of its id (ids
are often made from titles); a plain text block inside the article stays even if it
recurs. Reader comments go wherever they stand, articles of their own among them.

Defined cases: null or empty html gives an empty text; a null url is a host of its
own (the empty one); repeated rows give equal results; unclosed elements end where
HTML lets them end, at the latest with the page; a tag that is not finished when the
page ends is text; <br> is white space inside a block; very long and very deep pages
take linear time; an empty table gives no rows; extra columns are ignored; a null id is
passed through.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .parts import mix
from .urlfilter import url_parts

#: A subtree is a template if so many different pages of its host, and such a share of them, hold it.
MIN_PAGES, MIN_SHARE = 10, 0.001
#: Up to so many template hashes (8 bytes each) are broadcast; beyond, they are joined to the pages.
BROADCAST_ROWS = 500_000
#: Stands for the page itself among its subtrees.
PAGE = 0x5061676521

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
PLAIN = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr figcaption caption".split())
ENDS_P = BLOCK - {"body", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
NOT_ARTICLE = set("head script style noscript template iframe object svg math canvas nav footer aside form button select textarea input dialog menu audio video map".split())
NOT_ARTICLE_ROLE = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
COMMENTS = set("comment comments commentlist disqus respond replies".split())
NOT_ARTICLE_NAME = COMMENTS | set("ad ads adv advert advertisement adverts adsbygoogle sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended widget pagination pager skip toolbar".split())
#: What may follow a telling word in a class.
GENERIC = set("area bar block bottom box container content form inner item items left link links list main right section slot thread top unit widget wrap wrapper".split())
NEVER_BY_NAME = {"html", "body", "article", "main"}
#: What an element's own marks say: nothing, cut it if its path recurs, cut it.
STAYS, IF_COUNTED, CUT = 0, 1, 2

# possessive, so that no character of a tag is looked at again
TAG = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+)>""", re.S
)
FACTOR = 0x9E3779B97F4A7C15
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACE = re.compile(r"\s+")


def telling(word: str, names: set[str], by_parts: bool) -> bool:
    """Whether a class is a name, or (by_parts) ends with one, or is one followed by generic words."""
    parts = re.split(r"[-_]+", word)
    return word in names or "".join(parts) in names or by_parts and (parts[-1] in names or parts[0] in names and all(x in GENERIC or x in names or x.isdigit() for x in parts[1:]))


def marks(tag: str, attributes: str, in_article: bool) -> int:
    """What tag, role, id, class or hidden say of an element: STAYS, IF_COUNTED or CUT."""
    if tag in NOT_ARTICLE or tag == "header" and not in_article:
        return CUT
    out = STAYS
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(values).lower(), name.lower()
        if name in ("class", "id") and tag not in PLAIN and tag not in ("html", "body", "main"):
            words = value.split() if name == "class" else [value.strip()]
            if any(telling(w, COMMENTS, name == "class") for w in words):
                return CUT
            if tag in NEVER_BY_NAME and not in_article:
                continue
            if any(telling(w, NOT_ARTICLE_NAME, not in_article and name == "class") for w in words):
                return CUT
            if name == "class" and any(telling(w, NOT_ARTICLE_NAME, True) for w in words):
                out = IF_COUNTED
        elif tag in NEVER_BY_NAME and not in_article:
            continue
        elif name == "role" and value in NOT_ARTICLE_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return CUT
    return out


def class_of(attributes: str) -> str:
    return next((" ".join(sorted("".join(v).lower().split())) for n, *v in ATTRIBUTE.findall(attributes) if n.lower() == "class"), "") if attributes else ""


@lru_cache(24)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of FACTOR and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, f, np.uint64)]) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))


def held_in(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array: a search for each key, however long the array is."""
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


class Page:
    """One pass over the markup: text pieces with their block, and the element subtrees."""

    def __init__(self, source: str):
        self.source = source
        #: elements: [tag, start, end, parent, cut by its own marks, inside an article, what its marks say, path, inside a link]
        self.elements: list[list] = []
        self.texts: list[tuple[int, int, int, int]] = []  # block number, element, start, end
        self.has_article = False
        self._read()

    def _read(self) -> None:
        s, elements, texts = self.source, self.elements, self.texts
        stack: list[int] = [-1]
        open_tags: list[str] = [""]
        is_open: Counter = Counter()
        block, at, n = 0, 0, len(s)
        last_end = s.rfind(">")  # beyond it there is no tag

        def close(depth: int, end: int) -> None:
            while len(stack) > depth:
                elements[stack.pop()][2] = end
                is_open[open_tags.pop()] -= 1

        def top(tag: str) -> int:
            depth = len(open_tags) - 1
            while open_tags[depth] != tag:
                depth -= 1
            return depth

        for m in iter(lambda: TAG.search(s, at) if at <= last_end else None, None):
            start, end = m.span()
            tag = m[2]
            if start > at:
                texts.append((block, stack[-1], at, start))
            at = end
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCK:
                    block += 1
                if is_open[tag]:
                    depth = top(tag)
                    close(depth + 1, start)
                    close(depth, end)
                continue
            if tag in BLOCK:
                block += 1
            if tag in ENDS_P and is_open["p"]:
                close(top("p"), start)
            elif tag in ENDS and any(is_open[x] for x in ENDS[tag]):
                for depth in range(len(open_tags) - 1, 0, -1):
                    if open_tags[depth] in ENDS[tag]:
                        close(depth, start)
                        if tag != "tr":
                            break
                    elif open_tags[depth] in HOLDS[tag]:
                        break
            if tag in VOID:
                if tag == "br":
                    texts.append((block, stack[-1], n, n))
                continue
            parent = stack[-1]
            inside = parent >= 0 and elements[parent][5]
            said = marks(tag, m[3], inside)
            cut = parent >= 0 and elements[parent][4] or said == CUT
            above, linked = (elements[parent][7], elements[parent][8]) if parent >= 0 else (0, False)
            path = xxhash.xxh64_intdigest(f"{above}/{tag}.{class_of(m[3])}")
            article = inside or tag in ("article", "main") and not cut
            self.has_article |= article
            elements.append([tag, start, n, parent, cut, article, said, path, linked or tag == "a"])
            if tag in RAW:
                close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(s, at)
                stop, after = close_tag.span() if close_tag else (n, n)
                elements[-1][2], at = after, after
                if tag not in NOT_ARTICLE and stop > end:
                    texts.append((block, len(elements) - 1, end, stop))
                continue
            stack.append(len(elements) - 1)
            open_tags.append(tag)
            is_open[tag] += 1
        if at < n:
            texts.append((block, stack[-1], at, n))

    def _hash(self, ranges: list[tuple[int, int]]) -> np.ndarray:
        """Of these ranges of the markup, white space collapsed; from running sums over the page, so that nested subtrees cost no more."""
        if not hasattr(self, "sums"):
            c = np.frombuffer(self.source.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            white = (c == 32) | ((c >= 9) & (c <= 13))
            keep = ~white
            keep[:1] = True
            keep[1:] |= ~white[:-1]
            c = np.where(white, np.uint64(32), c)[keep]
            n = 1 << len(c).bit_length()
            up, down = powers(n) if n <= 1 << 20 else powers.__wrapped__(n)  # those of very long pages are not kept
            self.sums = np.r_[0, np.cumsum(keep)], np.r_[np.uint64(0), np.cumsum(mix(c + np.uint64(1)) * up[: len(c)])], down
        place, total, down = self.sums
        begin, end = (place[np.array([r[k] for r in ranges], np.int64)] for k in (0, 1))
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def fingerprint(self) -> int:
        """Of the article if it is marked, else of the page: equal for copies."""
        body = [(e[1], e[2]) for e in self.elements if e[5] and e[0] in ("article", "main")] or [(0, len(self.source))]
        return xxhash.xxh64_intdigest(self._hash(body).tobytes()) - (1 << 63)

    def hashes(self, host: str) -> tuple[np.ndarray, np.ndarray]:
        """Block elements, but for plain text inside an article, and for each a hash of host and subtree."""
        at = [i for i, e in enumerate(self.elements) if e[0] in BLOCK and e[0] not in NEVER_BY_NAME and not (e[5] and e[0] in PLAIN)]
        key = mix(self._hash([(self.elements[i][1], self.elements[i][2]) for i in at]) ^ np.uint64(xxhash.xxh64_intdigest(host)))
        by_path = self.suspects()
        paths = np.array([self.elements[i][7] for i in by_path], np.uint64)
        key = np.r_[key, mix(paths ^ np.uint64(xxhash.xxh64_intdigest(f"path {host}")))]
        return np.array(at + by_path, np.int64), key.view(np.int64)

    def suspects(self) -> list[int]:
        """Elements that are templates if their path recurs: by a part of a class inside the article, or outside as their whole text is links, two at least."""
        e = self.elements
        text, linked, links = np.zeros(len(e), np.int64), np.zeros(len(e), np.int64), np.zeros(len(e), np.int64)
        for _, i, start, end in self.texts:
            if i >= 0:
                n = len(self.source[start:end].strip())
                text[i] += n
                linked[i] += n if e[i][8] else 0
        for i in range(len(e) - 1, -1, -1):
            parent = e[i][3]
            if parent >= 0:
                text[parent] += text[i]
                linked[parent] += linked[i]
                links[parent] += links[i] + (e[i][0] == "a")
        menu = lambda i: links[i] > 1 and text[i] > 0 and linked[i] == text[i] and not e[i][5]
        return [i for i, x in enumerate(e) if not x[4] and x[0] in BLOCK and x[0] not in PLAIN and x[0] not in NEVER_BY_NAME and (x[6] == IF_COUNTED or menu(i))]

    def text(self, cut: set[int]) -> str:
        elements = self.elements
        gone = [False] * len(elements)
        for i, e in enumerate(elements):
            gone[i] = e[4] or i in cut or e[3] >= 0 and gone[e[3]]
        blocks: dict[int, list[str]] = {}
        for block, i, start, end in self.texts:
            if (i < 0 and self.has_article) or i >= 0 and (gone[i] or self.has_article and not elements[i][5]):
                continue
            blocks.setdefault(block, []).append(self.source[start:end] or " ")
        lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per page: id, url, text. Template counts are made when this is called."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    host, _ = url_parts(pages[url_col].cast("string"))
    base = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), host.alias("host"), pages[html_col].cast("string").alias("html"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, prints, hosts = [], [], []
            for h, s in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(s or "")
                own = set(page.hashes(h)[1].tolist()) | {PAGE}
                keys += own
                prints += [page.fingerprint()] * len(own)
                hosts += [xxhash.xxh64_intdigest(h) - (1 << 63)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, keys, prints)], ["host_key", "subtree", "print"])

    found = base.select("host", "html").mapInArrow(subtrees, "host_key long, subtree long, print long")
    counts = found.groupBy("host_key", "subtree", "print").agg(F.lit(1).alias("one")).groupBy("host_key", "subtree").count()
    counts = checkpointed(counts.where((F.col("count") >= min_pages) | (F.col("subtree") == PAGE)))  # templates and hosts
    pages_of = counts.where(F.col("subtree") == PAGE).select("host_key", F.col("count").alias("pages"))
    held = counts.where(F.col("subtree") != PAGE).join(pages_of, "host_key").where(F.col("count") >= F.col("pages") * min_share)
    held = checkpointed(held.select("subtree").distinct())
    few = held.count() <= broadcast_rows
    known = np.sort(np.array([r.subtree for r in held.collect()], np.int64)) if few else None  # at most broadcast_rows numbers

    kind = pages.schema[id_col].dataType.simpleString()
    if few:
        shared = spark.sparkContext.broadcast(known)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            templates = shared.value
            for b in batches:
                out = []
                for h, s in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = Page(s or "")
                    at, key = page.hashes(h)
                    out.append(page.text(set(at[held_in(key, templates)].tolist())))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

        return base.mapInArrow(write, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)

    # Too many templates to broadcast: each page is joined to those that it holds. Equal pages share a key.
    def with_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_, keys = [], []
            for p, h, s in zip(b.column("page").to_pylist(), b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = set(Page(s or "").hashes(h)[1].tolist())
                pages_ += [p] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(pages_, pa.int64()), pa.array(keys, pa.int64())], ["page", "subtree"])

    keyed = base.withColumn("page", F.xxhash64("host", "html"))
    own = keyed.select("page", "host", "html").mapInArrow(with_page, "page long, subtree long").distinct()
    cuts = own.join(held, "subtree").groupBy("page").agg(F.collect_list("subtree").alias("cuts"))

    def write_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, s, c in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                page, c = Page(s or ""), set(c or ())
                out.append(page.text({i for i, k in zip(*map(np.ndarray.tolist, page.hashes(h)), strict=True) if k in c}))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    return keyed.join(cuts, "page", "left").select("id", "url", "host", "html", "cuts").mapInArrow(write_joined, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
