"""Posts from rendered feed markup.

A small parser turns each page into rows, one for every element and text piece in
document order, with the place where its subtree ends. All the rest is done on these
rows by Spark: an element contains another exactly if the other's place lies between
its own and its end, so "inside", "outermost" and "the only button within" are running
minima and maxima over windows of a page, and texts are put together by grouping. No
step is longer than a sort of a page's rows, however deep or wide the page is.

Defined cases: null or empty html and pages without a post give no rows; repeated page
rows give their posts as often; the page id may be null; what comments hold is not read;
scripts and styles have no text. Labels of controls and lines are read up to LABEL
characters, texts and links as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# What marks the parts of a post in the feed's layouts, as (element or "", attribute, how, value);
# how: = equal, ^ begins with, * holds, ~ has the word.
POST = [("", "data-urn", "^", "urn:li:activity:"), ("", "data-id", "^", "urn:li:activity:"), ("div", "data-view-name", "=", "feed-full-update"), ("div", "componentkey", "*", "FeedType"), ("div", "class", "~", "feed-shared-update-v2")]
COMMENT = [
    ("", "class", "~", "comments-comments-list"), ("", "class", "~", "feed-shared-update-v2__comments-container"), ("", "class", "~", "comments-comment-entity"), ("", "class", "~", "comments-comment-item"),
    ("article", "data-id", "^", "urn:li:comment:"), ("", "data-view-name", "^", "comment"), ("", "data-view-name", "*", "comment-list"),
]
ROOT = [("main", "", "", ""), ("", "role", "=", "main")]
BOUNDARY = [*ROOT, ("body", "", "", ""), ("", "data-testid", "=", "lazy-column"), ("", "data-sdui-screen", "*", "")]
ACTION = [("button", "", "", ""), ("", "role", "=", "button")]
TEXT = [("", "data-testid", "=", "expandable-text-box"), ("", "class", "~", "feed-shared-update-v2__description"), ("", "class", "~", "feed-shared-inline-show-more-text"), ("", "class", "~", "update-components-text"), ("", "class", "~", "feed-shared-text")]
LEFT_TO_RIGHT = [("", "dir", "=", "ltr")]
PROFILE = [("a", "href", "*", "/in/"), ("a", "href", "*", "/company/"), ("a", "data-view-name", "=", "feed-actor-image")]
NO_PROSE = [*ACTION, *PROFILE[:2], ("svg", "", "", ""), ("img", "", "", ""), ("video", "", "", ""), ("", "aria-hidden", "=", "true")]
HIDDEN = [("", "class", "~", "visually-hidden")]
STRIP = [*HIDDEN, *ACTION, ("", "class", "~", "feed-shared-inline-show-more-text__see-more-less-toggle")]
CARD = [("", "class", "~", "update-components-article__subtitle"), ("", "class", "~", "feed-shared-article__subtitle"), ("", "class", "~", "update-components-article-first-party__subtitle")]
ACTOR, DESCRIPTION, AGE, TITLE = ([("", "class", "~", f"update-components-actor__{x}")] for x in ("meta", "description", "sub-description", "title"))
ACTION_KINDS = [r"^send(?: in a private message)?$", r"^repost$", r"^(?:like|react like|reaction button state.*)$", r"^comment$"]
COUNTS = {"reactions": "social-details-social-counts__reactions-count", "comments": "social-details-social-counts__comments", "reposts": "social-details-social-counts__item--right-aligned"}
NUMBER = r"(\d[\d,.]*\s*[KkMm]?)"
COUNT_PATTERNS = {"reactions": [(rf"^{NUMBER}\s+reactions?\b", 0), (rf"\band\s+{NUMBER}\s+others?\b", 1)], "comments": [(rf"^{NUMBER}\s+comments?\b", 0)], "reposts": [(rf"^{NUMBER}\s+(?:reposts?|shares?)\b", 0)]}
COUNT_WORDS = {"reactions": r"\b(?:reactions?|likes?|react)\b", "comments": r"\bcomments?\b", "reposts": r"\b(?:reposts?|shares?)\b"}
AGE_LINE = r"^\s*(?:\d+\s*(?:mo|m|h|d|w|yr|y)\b|just now|now\b)"
AGE_SHORT = r"\d+\s*(?:mo|m|h|d|w|yr|y)\b|just now"
NOT_HEADLINE = r"^(?:•\s*)?(?:following|follow|promoted|sponsored|verified|\d+(?:st|nd|rd|th)\+?|•.*|\d[\d,.]*\s*followers?)$"
TEXT_LEAST, PROSE_LEAST, COUNT_TEXT_MOST, AGE_MOST, LINE_MOST, NAME_MOST = 20, 25, 60, 40, 220, 60

ATTRIBUTES = frozenset(x[1] for rules in (POST, COMMENT, BOUNDARY, ACTION, TEXT, LEFT_TO_RIGHT, PROFILE, NO_PROSE, STRIP) for x in rules) - {""} | {"aria-label"}
#: Characters of a label that are read; rows of nodes in a batch.
LABEL, ROWS = 256, 20_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div li article section".split())
CLOSES_P = BLOCKS | frozenset("ul ol dl table form header footer nav aside main h1 h2 h3 h4 h5 h6 pre blockquote".split())
WHITE = re.compile("[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", re.A)


class Nodes(HTMLParser):
    """The rows of a page. Each knows its parent, the nearest boundary above it, and the block that its text counts for."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[dict] = []
        self.open: Counter = Counter()  # of tags: an end tag without an open element costs nothing
        self.words: list[str] = []  # the page's text, white space collapsed
        self.at = 0
        self.feed(source)
        self.close()
        self.shut(0)
        self.said = "".join(self.words)

    def add(self, tag: str, attrs: dict[str, str], said: str | None = None) -> dict:
        up = self.stack[-1] if self.stack else None
        n = len(self.rows)
        bound = -1 if up is None else up["n"] if up["bounds"] else up["bound"]
        row = {"n": n, "last": n, "up": up, "tag": tag, "attrs": attrs, "text": said, "bound": bound, "begin": self.at, "end": self.at, "bounds": False, "before": None, "child": None}
        self.rows.append(row)
        return row

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and self.open["p"] or tag in ("li", "a") and self.stack and self.open[tag]:
            self.close_tag("p" if tag in CLOSES_P and self.open["p"] else tag, only_top=tag == "li")
        row = self.add(tag, {k: v or "" for k, v in attrs if k in ATTRIBUTES})
        row["bounds"] = any(tag == t or a and _fits(row["attrs"].get(a), how, value) for t, a, how, value in BOUNDARY)
        if self.stack:
            row["before"], self.stack[-1]["child"] = self.stack[-1]["child"], row
        if tag not in VOID:
            self.stack.append(row)
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            self.close_tag(tag)

    def close_tag(self, tag: str, only_top: bool = False) -> None:
        if only_top and self.stack[-1]["tag"] != tag:
            return
        k = len(self.stack) - 1
        while self.stack[k]["tag"] != tag:
            k -= 1
        self.shut(k)

    def shut(self, depth: int) -> None:
        """Close all elements down to this depth."""
        while len(self.stack) > depth:
            row = self.stack.pop()
            self.open[row["tag"]] -= 1
            row["last"], row["end"], row["child"] = len(self.rows) - 1, self.at, None

    def handle_data(self, data: str) -> None:
        if not self.stack or self.stack[-1]["tag"] not in ("script", "style"):
            self.add("#text", {}, data)
            word = WHITE.sub(" ", data)
            if word[:1] == " " and (not self.words or self.words[-1][-1] == " "):
                word = word[1:]
            if word:
                self.words.append(word)
                self.at += len(word)


def _fits(v: str | None, how: str, value: str) -> bool:
    return v is not None and (v == value if how == "=" else v.startswith(value) if how == "^" else value in v)


NODES = "page bigint, page_id bigint, copies bigint, n int, last int, up int, up_last int, bound int, block int, after_actor boolean, tag string, attrs map<string,string>, said string, label string, label_size int"


def nodes(pages: DataFrame) -> DataFrame:
    """(page, page_id, copies, html) as rows: `said` is the text of a text piece or a link, `label` the start of an element's text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(NODES))

    def rows_of(page: int, page_id: int | None, copies: int, source: str) -> Iterator[dict]:
        made = Nodes(source)
        for r in made.rows:
            up, before, text = r["up"], r["before"], r["text"]
            r["block"] = r["n"] if text is None and r["tag"] in BLOCKS else up["block"] if up is not None else None
            whole = made.said[r["begin"] : r["end"]] if r["tag"] == "a" else ""
            yield {
                "page": page, "page_id": page_id, "copies": copies, "n": r["n"], "last": r["last"], "up": None if up is None else up["n"], "up_last": None if up is None else up["last"], "bound": r["bound"],
                "block": r["block"] if r["block"] is not None else None if up is None else up["n"], "after_actor": before is not None and before["tag"] == "a" and before["attrs"].get("data-view-name") == "feed-actor-image",
                "tag": r["tag"], "attrs": list(r["attrs"].items()), "said": whole.strip(" ") if text is None else text, "label": made.said[r["begin"] : min(r["end"], r["begin"] + LABEL)].strip(" "), "label_size": r["end"] - r["begin"],
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, page_id, copies, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = []
                for r in rows_of(page, page_id, copies, source):
                    held.append(r)
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    return pages.select("page", "page_id", "copies", "html").mapInArrow(run, NODES)


def fits(rules: list[tuple[str, str, str, str]]) -> Column:
    """Whether a row is an element that one of the rules names."""

    def one(tag: str, name: str, how: str, value: str) -> Column:
        v = F.col("attrs")[name]
        test = {"": F.lit(True), "=": v == value, "^": v.startswith(value), "*": F.contains(v, F.lit(value)), "~": F.contains(F.concat(F.lit(" "), F.regexp_replace(v, r"\s", " "), F.lit(" ")), F.lit(f" {value} "))}[how]
        return (F.col("tag") == tag) & test if tag else test

    return (F.col("tag") != "#text") & F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(one(*r), F.lit(False)) for r in rules]), F.lit(False))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, T.java(r"\s+", False), " "))


def tidy(c: Column) -> Column:
    """Lines of a text: single spaces, no more than one empty line, no space around."""
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \\t\u00a0]+", " "), " *\\n *", "\n"), "\\n{3,}", "\n\n")
    return F.regexp_replace(lines, T.java(r"^\s+|\s+$", False), "")


def windows(*by: str) -> tuple:
    """Over the rows before (in document order), up to and including, and after each one; the last runs backwards, so that it stays linear."""
    w, back = W.partitionBy(*by).orderBy("n"), W.partitionBy(*by).orderBy(F.desc("n"))
    return w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0), back.rowsBetween(W.unboundedPreceding, -1)


def within(flag: Column, window) -> Column:
    """Whether a row with the flag, of those in the window, contains this one."""
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(window) >= F.col("n"), F.lit(False))


def find_posts(rows: DataFrame) -> DataFrame:
    """The rows inside posts, with `post`, the place of the post's own element."""
    before, upto, after = windows("page")
    page = W.partitionBy("page")
    n, last = F.col("n"), F.col("last")
    place = F.struct("n", "last")
    d = rows.select("*", fits(POST).alias("marked"), fits(ACTION).alias("action"), fits(PROFILE).alias("profile"), fits(ROOT).alias("is_root"), F.coalesce(F.nullif(clean(F.col("attrs")["aria-label"]), F.lit("")), "label").alias("control"))
    d = d.withColumn("marked", F.col("marked") & ~within(F.col("marked"), before)).withColumn("root", F.min(F.when(F.col("is_root"), place)).over(page))
    in_root = F.col("root").isNull() | (n > F.col("root.n")) & (n <= F.col("root.last"))
    kinds = range(len(ACTION_KINDS))
    d = d.select("*", *[(F.col("action") & in_root & T.matches(F.col("control"), p)).alias(f"is{k}") for k, p in enumerate(ACTION_KINDS)])
    # the button of a kind before this row (or this one), and the next one
    d = d.select("*", F.min(F.when(F.col("marked"), n)).over(after).alias("next_marked"), *[F.min(F.when(F.col(f"is{k}"), n)).over(after).alias(f"next{k}") for k in kinds])
    d = d.select("*", *[F.min(F.when(F.col(f"is{k}"), F.struct("n", F.col(f"next{k}").alias("next"), "bound"))).over(after).alias(f"first{k}") for k in kinds])
    d = d.select("*", *[F.max(F.when(F.col(f"is{k}"), n)).over(upto).alias(f"gone{k}") for k in kinds])

    def largest(k: int) -> Column:
        """Whether this is the largest element with one button of the kind inside, below any boundary."""
        m = F.col(f"first{k}")
        alone = (m["n"] <= last) & F.coalesce(m["next"] > last, F.lit(True)) & (n > m["bound"])
        above = (F.col("up") > m["bound"]) & F.coalesce(F.col(f"gone{k}") <= F.col("up"), F.lit(True)) & F.coalesce(m["next"] > F.col("up_last"), F.lit(True))
        return F.coalesce(alone, F.lit(False)) & ~F.coalesce(above, F.lit(False))

    d = d.select("*", *[largest(k).alias(f"top{k}") for k in kinds]).select("*", *[F.count_if(F.col(f"top{k}")).over(page).alias(f"tops{k}") for k in kinds])
    most = F.greatest(*[F.col(f"tops{k}") for k in kinds])
    chosen = F.coalesce(*[F.when(F.col(f"tops{k}") == most, F.col(f"top{k}")) for k in kinds])
    more = chosen & ~within(F.col("marked"), upto) & ~F.coalesce(F.col("next_marked") <= last, F.lit(False))
    d = d.withColumn("starts", F.col("marked") | more).withColumn("starts", F.col("starts") & ~within(F.col("starts"), before))
    flags = {"in_profile": F.col("profile"), "in_action": F.col("action"), "in_hidden": fits(HIDDEN), "in_no_prose": fits(NO_PROSE)}
    d = d.select("*", F.max(F.when(F.col("starts"), place)).over(upto).alias("p"), *[within(c, upto).alias(k) for k, c in flags.items()])
    drop = ["marked", "is_root", "root", "control", "starts", "next_marked", "bound", "up", "up_last", *[f"{x}{k}" for k in kinds for x in ("is", "next", "first", "gone", "top", "tops")]]
    return d.where("p.last >= n").withColumn("post", F.col("p.n")).drop("p", *drop)


def prose(d: DataFrame) -> DataFrame:
    """Adds the place of the block with the most text, widened while it only gains sibling paragraphs; null if it is short or not needed."""
    n, last = F.col("n"), F.col("last")
    text, post = F.col("tag") == "#text", W.partitionBy("page", "post")
    d = d.withColumn("size", F.when(text & ~F.col("in_no_prose") & ~F.col("has_text"), F.length(clean(F.col("said")))).otherwise(0))
    own = W.partitionBy("page", "post", "key")
    d = d.withColumn("key", F.when(text, F.col("block")).otherwise(n))
    d = d.select("*", F.when(~text, F.sum("size").over(own)).otherwise(0).alias("mass"), F.min(F.when(F.col("size") > 0, n)).over(own).alias("first_at"))
    d = d.withColumn("best", F.max(F.when(F.col("mass") >= PROSE_LEAST, F.struct("mass", -F.col("first_at"), n.alias("at")))).over(post)["at"])
    # running sums of text and controls, at the begin of each element and, for those around the best one, at the end
    around = (n <= F.col("best")) & (last >= F.col("best")) & ~text & ((n > F.col("post")) | (n == F.col("best")))
    d = d.withColumn("around", F.coalesce(around, F.lit(False)))
    d = d.select("*", F.explode(F.when(F.col("around"), F.array(F.struct(n.alias("pos"), F.lit(0).alias("rank")), F.struct(last.alias("pos"), F.lit(1).alias("rank")))).otherwise(F.array(F.struct(n.alias("pos"), F.lit(0).alias("rank"))))).alias("e")).select("*", "e.*").drop("e")
    begins = F.col("rank") == 0
    w = W.partitionBy("page", "post").orderBy("pos", "rank")
    d = d.select("*", *[F.sum(F.when(begins, c).otherwise(0)).over(w).alias(k) for k, c in (("mass_at", F.col("mass")), ("controls_at", (F.col("action") | F.col("profile")).cast("long")))])
    element = W.partitionBy("page", "post", "n")
    total = F.max(F.when(~begins, F.col("mass_at"))).over(element) - F.max(F.when(begins, F.col("mass_at") - F.col("mass"))).over(element)
    controls = F.max(F.when(~begins, F.col("controls_at"))).over(element) - F.max(F.when(begins, F.col("controls_at"))).over(element)
    d = d.select("*", total.alias("total"), controls.alias("controls")).where("rank = 0")
    chain = W.partitionBy("page", "post", "around").orderBy(F.desc("n"))  # from the best block outwards
    d = d.withColumn("inner", F.lag("total").over(chain))
    extra = F.col("total") - F.col("inner")
    stop = F.coalesce((extra > F.col("inner")) | (extra > 0) & (F.col("controls") > 0), F.lit(False))
    d = d.withColumn("stopped", F.max(F.when(F.col("around") & stop, 1).otherwise(0)).over(chain))
    d = d.withColumn("prose", F.min(F.when(F.col("around") & (F.col("stopped") == 0), F.struct("n", "last"))).over(post))
    return d.drop("size", "key", "mass", "first_at", "best", "around", "pos", "rank", "mass_at", "controls_at", "total", "controls", "inner", "stopped")


def count_of(kind: str) -> Column:
    """The count that a row states, if any: of its class, else by its labels."""
    aria, text = clean(F.col("attrs")["aria-label"]), F.col("label")
    short = lambda c, size: (c != "") & (size <= COUNT_TEXT_MOST)
    number = lambda c, p, add: T.parse_count(F.nullif(F.regexp_extract(c, T.java(p), 1), F.lit(""))) + add
    said = [F.when(short(c, size), number(c, p, add)) for c, size in ((aria, F.length(aria)), (text, F.col("label_size"))) for p, add in COUNT_PATTERNS[kind]]
    bare = F.when(T.matches(aria, COUNT_WORDS[kind]) & T.matches(text, rf"^{NUMBER}$"), T.parse_count(text))
    return F.when(F.col("tag").isin("button", "a", "span", "li", "p"), F.coalesce(*said, bare))


def first(value: Column, when: Column | None = None, *order: Column) -> Column:
    """Aggregate: the first value in document order that is not null."""
    ok = value.isNotNull() if when is None else value.isNotNull() & when
    return F.min(F.when(ok, F.struct(*[o.alias(f"o{i}") for i, o in enumerate((*order, F.col("n")))], value.alias("v"))))["v"]


def in_order(value: Column, when: Column, rank: int = 0) -> Column:
    """Aggregate: (rank, n, value) of all rows that count; to be sorted."""
    return F.collect_list(F.when(when, F.struct(F.lit(rank).alias("r"), F.col("n").alias("n"), value.alias("v"))))


def read_nodes(rows: DataFrame) -> DataFrame:
    """A row per post: its strings and counts."""
    _, upto, after = windows("page", "post")
    before = windows("page", "post")[0]
    n, last, tag, label = F.col("n"), F.col("last"), F.col("tag"), F.col("label")
    d = find_posts(rows).withColumn("line", tag.isin("p", "span"))
    d = d.withColumn("inner_line", F.min(F.when(tag.isin("p", "span", "div"), n)).over(after)).withColumn("in_comment", within(fits(COMMENT), upto)).where("not in_comment")
    inner = n > F.col("post")
    d = d.withColumn("t", fits(TEXT)).withColumn("t", F.col("t") & inner & ~within(F.col("t"), before)).withColumn("has_text", F.max("t").over(W.partitionBy("page", "post")))
    d = d.withColumn("l", fits(LEFT_TO_RIGHT)).withColumn("l", F.col("l") & inner & ~F.col("has_text") & ~within(F.col("l"), before) & ~F.col("in_profile"))
    d = prose(d)
    one = lambda rules: F.min(F.when(fits(rules) & inner, F.struct("n", "last"))).over(W.partitionBy("page", "post"))
    d = d.select("*", one(DESCRIPTION).alias("described"), one(TITLE).alias("titled"), F.min(F.when(inner & (F.col("after_actor") & (tag == "a") | fits(ACTOR)), F.struct("n", "last"))).over(W.partitionBy("page", "post")).alias("actor"))
    linked = F.min(F.when(inner & F.col("after_actor") & (tag == "a"), F.struct("n", "last"))).over(W.partitionBy("page", "post"))
    d = d.withColumn("linked", linked).withColumn("actor_line", F.coalesce((tag == "p") & (n > F.col("linked.n")) & (n <= F.col("linked.last")), F.lit(False)))
    # each row once for the post (kind R), and once for each text that it is part of
    latest = lambda flag: F.max(F.when(flag, F.struct("n", "last"))).over(upto)
    d = d.select("*", latest(F.col("t")).alias("of_t"), latest(F.col("l")).alias("of_l"), latest(F.col("actor_line")).alias("of_a"))
    part = lambda kind, owner: F.when((n >= owner["n"]) & (n <= owner["last"]), F.struct(F.lit(kind).alias("kind"), owner["n"].alias("owner")))
    d = d.withColumn("part", F.explode(F.array_compact(F.array(F.struct(F.lit("R").alias("kind"), F.col("post").alias("owner")), part("T", F.col("of_t")), part("L", F.col("of_l")), part("P", F.col("prose")), part("D", F.col("described")), part("N", F.col("titled")), part("A", F.col("of_a"))))))
    d = d.select("*", "part.kind", "part.owner")
    text_upto = W.partitionBy("page", "post", "kind", "owner").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    row, below = F.col("kind") == "R", n > F.col("owner")
    stripped = within(fits(STRIP) & below, text_upto)
    piece = F.when(tag == "#text", F.struct(n.alias("at"), F.lit(0).alias("end"), F.col("said"))).when(tag == "br", F.struct(n.alias("at"), F.lit(0).alias("end"), F.lit("\n").alias("said"))).when(tag.isin("p", "li", "div") & below, F.struct(last.alias("at"), F.lit(1).alias("end"), F.lit("\n").alias("said")))
    d = d.select("*", F.when(~row & ~stripped, piece).alias("piece"))
    href = F.col("attrs")["href"]
    link = (tag == "a") & (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")
    domain = F.get(F.split(label, "[\\s•·|]+"), F.lit(0))
    quiet = F.col("line") & ~F.coalesce(F.col("inner_line") <= last, F.lit(False)) & ~F.col("in_action") & ~F.col("in_hidden") & F.col("label_size").between(2, LINE_MOST + 2) & F.length(label).between(2, LINE_MOST)
    in_actor = F.coalesce((n > F.col("actor.n")) & (n <= F.col("actor.last")), F.lit(False))
    person = F.regexp_replace("said", "^@", "")
    carries = F.col("tag").eqNullSafe("a") | (n == F.col("post"))
    activity = F.coalesce(*[F.nullif(F.regexp_extract(F.when(carries, F.col("attrs")[a]) if a == "href" else F.col("attrs")[a], r"urn:li:activity:(\d+)", 1), F.lit("")) for a in ("data-urn", "data-id", "componentkey", "href")])
    classed = lambda rules, value: first(value, row & inner & fits(rules))
    facts = {
        "links": F.concat(in_order(F.struct(href.alias("href"), F.col("said").alias("text")), row & inner & link), in_order(F.struct(F.lit("").alias("href"), domain.alias("text")), row & inner & fits(CARD) & F.contains(domain, F.lit(".")), 1)),
        "people": in_order(person, row & inner & (tag == "a") & F.contains(href, F.lit("/in/")) & F.length(person).between(2, NAME_MOST)),
        "lines": in_order(label, row & inner & quiet), "activity": first(activity, row), "classed_age": classed(AGE, label),
        "near_age": first(label, row & inner & F.col("line") & (F.length(label) <= AGE_MOST) & (F.col("label_size") <= AGE_MOST + 2) & T.matches(label, AGE_LINE), (~in_actor).cast("int")),
        **{k: F.coalesce(classed([("", "class", "~", c)], T.parse_count(label)), first(count_of(k), row & inner)) for k, c in COUNTS.items()},
    }
    keys = ["page", "post", "page_id", "copies"]
    each = d.groupBy(*keys, "kind", "owner").agg(F.collect_list("piece").alias("pieces"), *[c.alias(k) for k, c in facts.items()])
    each = each.withColumn("whole", tidy(F.array_join(F.transform(F.array_sort("pieces"), lambda p: p["said"]), "")))
    texts = lambda kind, ok=F.lit(True): F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("whole") != "") & ok, F.struct("owner", "whole")))), lambda x: x)
    of_row = lambda k: F.max(F.when(row, F.struct(k)))[k]
    long = F.length("whole") >= TEXT_LEAST
    p = each.groupBy(*keys).agg(texts("T").alias("t"), texts("L", long).alias("l"), texts("P").alias("p"), texts("D").alias("d"), texts("N").alias("n"), texts("A").alias("a"), F.min(F.when(F.col("kind") == "T", F.col("owner"))).alias("t_at"), *[of_row(k).alias(k) for k in facts])
    chosen = F.when(F.col("t_at").isNotNull(), F.col("t")).when(F.size("l") > 0, F.slice("l", 1, 1)).otherwise(F.col("p"))
    p = p.withColumn("texts", chosen).withColumn("text", F.array_join(F.transform("texts", lambda x: x["whole"]), "\n\n")).where("text <> ''")
    start = F.coalesce("t_at", F.get("texts", F.lit(0))["owner"])
    lines = F.transform(F.filter(F.array_sort("lines"), lambda x: x["n"] < start), lambda x: x["v"])
    p = p.withColumn("lines", lines).withColumn("lines", F.filter("lines", lambda x, i: (i == 0) | (x != F.get("lines", i - 1))))
    pool = F.when(F.size("a") > 0, F.transform("a", lambda x: x["whole"])).otherwise(F.col("lines"))
    headline = F.filter(F.slice(pool, 2, 1 << 30), lambda x: ~T.matches(x, AGE_LINE) & ~T.matches(x, NOT_HEADLINE))
    sorted_values = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
    named = F.concat(F.transform(F.slice("n", 1, 1), lambda x: x["whole"]), F.transform(F.slice("lines", 1, 1), lambda x: F.regexp_replace(x, r"\s*•.*$", "")), sorted_values("people"))
    return p.select(
        "page_id", "copies", "activity", "text", F.coalesce(F.get("d", F.lit(0))["whole"], F.get(headline, F.lit(0)), F.lit("")).alias("author_headline"), F.coalesce("classed_age", "near_age").alias("age"),
        sorted_values("links").alias("links"), F.array_distinct(F.filter(named, lambda x: F.length(x) >= 2)).alias("names"), *COUNTS,
    )


def nodes_of(pages: DataFrame) -> DataFrame:
    """The nodes of (page_id, html) pages that may hold a post or a control; equal pages are read once, with their number."""
    marks = "|".join(["urn:li:activity:", "feed-full-update", "FeedType", "feed-shared-update-v2", "(?i:<button)", "(?i:role)"])
    d = pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string")).where(F.col("html").rlike(marks))
    d = d.groupBy(F.xxhash64("page_id", "html").alias("page")).agg(F.first("page_id").alias("page_id"), F.first("html").alias("html"), F.count("*").alias("copies"))
    return nodes(d)


def read_posts(pages: DataFrame) -> DataFrame:
    """Posts of (page_id, html) in the shape the features read, with person_names for redaction."""
    mail = F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:")), lambda x: F.lower(F.get(F.split(F.substring(x["href"], F.lit(8), F.length(x["href"])), r"\?"), F.lit(0))))
    emails = F.array_distinct(F.concat(F.transform(U.text_emails(F.col("text")), lambda e: F.lower(e)), mail))
    d = read_nodes(nodes_of(pages)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return d.select(
        "page_id", F.coalesce(F.concat(F.lit("urn:li:activity:"), "activity"), F.concat(F.lit("text:"), T.hash_text(F.col("text")))).alias("post_id"), "text", "author_headline",
        F.coalesce(F.nullif(F.regexp_extract("age", T.java(AGE_SHORT), 0), F.lit("")), "age").alias("age_text"), T.parse_age_hours(F.col("age")).alias("age_hours"),
        *COUNTS, "links", emails.alias("emails"), F.col("names").alias("person_names"),
    )


def layout_frequency(pages: DataFrame, k_labels: int = 25, k_values: int = 15) -> DataFrame:
    """(name, value, n): the most frequent labels of controls, and values of the layout's attributes with ids masked. For a look at unknown markup."""
    label = F.coalesce(F.nullif(clean(F.col("attrs")["aria-label"]), F.lit("")), "label")
    label = F.substring(F.regexp_replace(label, T.java(r"\b(by|for|of)\b.*$"), "$1 …"), 1, 40)
    masked = lambda c: F.substring(F.regexp_replace(c, r"(?i)[0-9a-f-]{16,}|\d{6,}", "#"), 1, 40)
    names = ["data-testid", "data-view-name", "componentkey"]
    said = F.array_compact(F.array(F.when(fits(ACTION) & (label != ""), F.struct(F.lit("label").alias("name"), label.alias("value"))), *[F.when(F.col("attrs")[a].isNotNull(), F.struct(F.lit(a).alias("name"), masked(F.col("attrs")[a]).alias("value"))) for a in names]))
    d = nodes_of(pages).where("tag <> '#text'").select("copies", F.explode(said).alias("x")).groupBy("x.name", "x.value").agg(F.sum("copies").alias("n"))
    place = F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "value"))
    return d.withColumn("place", place).where(F.col("place") <= F.when(F.col("name") == "label", k_labels).otherwise(k_values)).drop("place")
