"""Text primitives as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache, reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: An ASCII word border, and white space in the Unicode sense, for Java regular expressions.
BORDER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SPACES = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@cache
def strings_sql(items: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in items) + ")"


def strings(items: Sequence[str]) -> Column:
    """A literal list, in one step: literals made one by one take long."""
    return F.expr(strings_sql(tuple(items)))


def once_a_session(make: Callable) -> Callable:
    """Keeps what a function of plain arguments builds, for as long as its Spark context lives: long expressions take seconds to build."""
    made: dict = {}

    def get(*args):
        context = SparkContext._active_spark_context
        if made.get("context") is not context:
            made.clear()
            made["context"] = context
        if args not in made:
            made[args] = make(*args)
        return made[args]

    return get


def java(pattern: str, ignore_case: bool = True) -> str:
    """A lexicon pattern in Java's dialect."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out.append(border(pattern[:i], pattern[i + 2 :]))
        elif two == r"\s":
            out.append(SPACES if in_class else f"[{SPACES}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out.append(two[0])
            i += 1
            continue
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def border(before: str, after: str) -> str:
    """A word border, cheaper where what stands beside it starts or ends with a word character: one look at the next character comes first, as most places fail there."""
    group = re.match(r"\(\?:([^()]*)\)", after)
    firsts = [x[:1] for x in group[1].split("|")] if group else [after[:1]] if after[:1].isalnum() else ["0-9"] if after[:2] == r"\d" else []
    if (named := re.match(r"\[([A-Za-z]+)\]", after)) and "-" not in named[1]:
        firsts = list(named[1])
    if firsts and all(x.isalnum() or x == "0-9" for x in firsts):
        return f"(?=[{''.join(dict.fromkeys(firsts))}])(?<![A-Za-z0-9_])"
    if wide := re.match(r"\[([a-z0-9-]+)\]\+", after):
        return f"(?=[{wide[1]}]){BORDER}"
    ends = re.search(r"(?:^|[|(:])[^|()]*[A-Za-z0-9](?:[A-Za-z]\?)?$", before) or re.search(r"\((?:\?:)?((?:[A-Za-z]+\??\|)*[A-Za-z]+\??)\)$", before)
    return "(?![A-Za-z0-9_])" if ends else BORDER


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: it keeps nested expressions from growing with each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(java(pattern)), F.lit(False))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(c, p)
    return out


def holds(low: Column | str, needed: Sequence[Sequence[str]]) -> Column:
    """Whether lower-cased text (or the column of that name) holds one string of each list: what a pattern can't do without, at a fraction of its cost."""
    if isinstance(low, str):
        quoted = lambda w: strings_sql((w,))[6:-1]
        return F.expr(" AND ".join("(" + " OR ".join(f"contains({low}, {quoted(w)})" for w in words) + ")" for words in needed))
    out = F.lit(True)
    for words in needed:
        out = out & reduce(or_, [F.contains(low, F.lit(w)) for w in words])
    return out


def matches_if(c: Column, low: Column | str, pattern: str) -> Column:
    """matches(), tried only where the text holds what the pattern needs."""
    needed = L.NEEDED.get(pattern)
    found = matches(c, pattern)
    return found if needed is None else F.when(F.coalesce(holds(low, needed), F.lit(False)), found).otherwise(False)


def matches_any_if(c: Column, low: Column | str, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches_if(c, low, p)
    return out


def flatten(c: Column, compose: bool = False) -> Column:
    """Lower-case words joined by single spaces, with a space at both ends, so that phrases are substrings.

    compose adds compatibility composition (after lower-casing, as the order matters).
    """
    return let(F.lower(c), lambda low: flatten_low(low, compose))


#: A lower-case letter that stands for a plus while mask() blanks what separates words.
PLUS = "\uA7FA"
#: Letters and numbers that mask() does not know as such, and PLUS itself: with them a text is flattened by the general pattern.
UNMASKABLE = r"[[^\x00-\x7F]&&[\p{Lo}\p{Lm}\p{Lt}\p{Nl}\p{No}\x{A7FA}\x{10000}-\x{10FFFF}]]"


def flatten_low(low: Column, compose: bool = False) -> Column:
    """flatten() of text that is in lower case already.

    Most texts hold only cased letters and decimal digits beside what separates words; mask() blanks the rest in
    one look at each character, where a pattern of character classes takes several times as long.
    """
    from .compose import nfkc

    def one(t: Column) -> Column:
        # the commonest characters come first in the class, and single spaces are no match
        general = F.regexp_replace(t, r"[^a-z0-9+ \p{L}\p{N}][^a-z0-9+\p{L}\p{N}]*| [^a-z0-9+\p{L}\p{N}]+", " ")
        blanked = F.mask(F.replace(t, F.lit("+"), F.lit(PLUS)), F.lit(None), F.lit(None), F.lit(None), F.lit(" "))
        thinned = F.replace(F.replace(blanked, F.lit(PLUS), F.lit("+")), F.lit("  "), F.lit(" "))
        single = let(thinned, lambda b: F.when(F.contains(b, F.lit("  ")), F.regexp_replace(b, " {2,}", " ")).otherwise(b))
        return F.when(t.rlike(UNMASKABLE), general).otherwise(single)

    return F.concat(F.lit(" "), F.trim(let(nfkc(low), one) if compose else one(low)), F.lit(" "))


def key_words(phrases: Sequence[str]) -> dict[str, list[str]]:
    """Phrases by their longest word, as long words are in the fewest texts."""
    out: dict[str, list[str]] = {}
    for p in dict.fromkeys(phrases):
        out.setdefault(max(p.split(" "), key=len), []).append(p)
    return out


def phrases_in(flat: Column, phrases: Sequence[str]) -> Column:
    """The phrases (of several lists together) that occur in flattened text as whole words, in any order.

    The text's words are hashed once against the phrases' longest words; only phrases whose
    longest word the text has are searched for, so the cost hardly depends on their number.
    """
    by_key = key_words(phrases)
    table = F.map_from_arrays(strings(by_key), strings(["|".join(x) for x in by_key.values()]))
    there = F.array_intersect(F.split(flat, " "), strings(by_key))  # the set that is built holds the second list
    possible = F.flatten(F.transform(there, lambda w: F.split(F.element_at(table, w), r"\|")))
    return F.filter(possible, lambda p: ~F.contains(p, F.lit(" ")) | F.contains(flat, F.concat(F.lit(" "), p, F.lit(" "))))


#: What words are made of, and what separates them; ASCII is listed sign by sign, which costs one look at a table.
WORD_SIGNS = r"[abcdefghijklmnopqrstuvwxyz0123456789+]\p{L}\p{N}"
#: So many branches of a pattern are tried one by one; more are tried in groups by their first sign.
MOST_BRANCHES = 5


def phrase_tree(phrases: Sequence[str]) -> dict:
    """Phrases by their signs; the empty key ends a phrase."""
    root: dict = {}
    for p in phrases:
        at = root
        for sign in p:
            at = at.setdefault(sign, {})
        at[""] = {}
    return root


def tree_pattern(tree: dict) -> str:
    """The longest phrase of a tree that ends with a word; a phrase's spaces are any signs between words."""
    branches = [(k, (f"[^{WORD_SIGNS}]++" if k == " " else re.escape(k)) + tree_pattern(v)) for k, v in sorted(tree.items()) if k]
    signs = [b for b in branches if b[0] != " "]
    if len(signs) > MOST_BRANCHES:
        step = max(MOST_BRANCHES, round(len(signs) ** 0.5))
        groups = [signs[i : i + step] for i in range(0, len(signs), step)]
        out = [f"(?=[{''.join(k for k, _ in g)}])(?:{'|'.join(x for _, x in g)})" for g in groups]
    else:
        out = [x for _, x in signs]
    out += [x for k, x in branches if k == " "] + ([f"(?![{WORD_SIGNS}])"] if "" in tree else [])
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


@cache
def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """What stands before a word, with the longest phrase that begins there looked ahead at, so that the next word is looked at as well."""
    return f"[^{WORD_SIGNS}](?=({tree_pattern(phrase_tree(phrases))}))"


def phrases_in_low(low: Column, phrases: Sequence[str]) -> Column:
    """phrases_in() of lower-case text that need not be flattened: one pass over its signs, and neither a list of its words nor a copy without what separates them."""
    phrases = tuple(dict.fromkeys(phrases))
    longest = F.regexp_extract_all(F.concat(F.lit(" "), low), F.lit(phrase_pattern(phrases)), F.lit(1))
    plain = F.transform(longest, lambda p: F.regexp_replace(p, f"[^{WORD_SIGNS}]+", " "))
    # a phrase that begins with others stands for them too
    known = set(phrases)
    begun = {p: [" ".join(p.split(" ")[:n]) for n in range(1, p.count(" ") + 1)] for p in phrases}
    also = {p: "|".join([p, *[b for b in v if b in known]]) for p, v in begun.items() if any(b in known for b in v)}
    if also:
        table = F.map_from_arrays(strings(also), strings(list(also.values())))
        plain = F.flatten(F.transform(plain, lambda p: F.split(F.coalesce(F.element_at(table, p), p), r"\|")))
    return F.array_distinct(plain)


def among(found: Column, phrases: Sequence[str]) -> Column:
    """Those of phrases_in() that are in one list, in its order."""
    return F.array_intersect(strings(phrases), found)


def any_among(found: Column, phrases: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(found, strings(phrases)), F.lit(False))


def find_phrases(flat: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in flattened text as whole words, in list order."""
    return among(phrases_in(flat, phrases), phrases)


def has_phrase(flat: Column, phrases: Sequence[str]) -> Column:
    return any_among(phrases_in(flat, phrases), phrases)


def tokens(flat: Column) -> Column:
    return F.filter(F.split(F.trim(flat), " "), lambda t: t != "")


def may_be_in_tokens(label: Column, flat: Column) -> Column:
    """False where label_in_tokens() surely is: the tokens joined must hold the label. It costs a fraction of that."""
    return F.contains(F.replace(flat, F.lit(" "), F.lit("")), F.regexp_replace(F.lower(label), "[^a-z0-9]", ""))


#: Labels of up to so many characters are sought by a pattern; longer ones, which no host has, in lists of tokens.
LONGEST_LABEL = 63


def label_in_flat(label: Column, flat: Column) -> Column:
    """label_in_tokens() of flattened text, without a list of its tokens.

    The pattern finds the label's characters with single spaces between any of them, from one word's start to a
    word's end; what follows is kept, and must be the same that follows one to three words.
    """
    plain = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    pattern = lambda p: F.concat(F.lit("(?s) (?="), F.regexp_replace(p, "(?<=.)(?=.)", " ?"), F.lit(r" (.*)\z)(?:[^ ]+ ){1,3}\1\z"))
    short = let(plain, lambda p: (F.length(p) >= 3) & F.rlike(flat, pattern(p)))
    return F.coalesce(F.when(F.length(plain) <= LONGEST_LABEL, short).when(may_be_in_tokens(label, flat), label_in_tokens(label, tokens(flat))), F.lit(False))


def may_be_in_text(label: Column, low: Column) -> Column:
    """False where label_in_flat() of the flattened text surely is: lower-case text must hold the label's signs with nothing but what separates words between them."""
    pattern = lambda p: F.regexp_replace(p, "(?<=.)(?=.)", f"[^{WORD_SIGNS.replace(chr(92), chr(92) * 2)}]*+")
    return let(F.regexp_replace(F.lower(label), "[^a-z0-9]", ""), lambda p: (F.length(p) > LONGEST_LABEL) | ((F.length(p) >= 3) & F.rlike(low, pattern(p))))


def label_in_tokens(label: Column, toks: Column) -> Column:
    """Whether the label (letters and digits, three at least) is one token, or two or three adjacent ones joined."""
    plain = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    n = F.size(toks)
    # tokens beside the next one and the one after it, so that the list is made once and not for each place
    near = F.arrays_zip(toks.alias("a"), F.slice(toks, F.lit(2), n).alias("b"), F.slice(toks, F.lit(3), n).alias("c"))
    found = F.exists(near, lambda z: (z["a"] == plain) | (F.concat(z["a"], z["b"]) == plain) | (F.concat(z["a"], z["b"], z["c"]) == plain))
    return F.coalesce((F.length(plain) >= 3) & F.coalesce(found, F.lit(False)), F.lit(False))


def parse_age_hours(c: Column) -> Column:
    """Hours of a relative age such as `5h`, `3mo` or `2 days ago`; null if there is none."""
    low = F.trim(F.lower(c))
    unit = r"(\d+)\s*(mo|months?|yrs?|years?|y|wks?|weeks?|w|days?|d|hrs?|hours?|h|mins?|minutes?|m|secs?|seconds?|s)\b"
    n = F.regexp_extract(low, java(unit, False), 1)
    name = F.regexp_extract(low, java(unit, False), 2)
    name = F.when((F.length(name) > 2) & name.endswith("s"), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)
    hours = F.lit(None).cast("double")
    for k, v in L.UNIT_HOURS.items():
        hours = F.when(name == k, F.lit(v)).otherwise(hours)
    now = low.rlike(java(r"^(just\s+)?now\b", False)) | low.startswith("just now")
    return F.when(c.isNull() | (c == ""), None).when(now, 0.0).when(n != "", n.cast("double") * hours)


def format_age(hours: Column) -> Column:
    out = lambda unit, per: F.concat(F.round(hours / per).cast("long").cast("string"), F.lit(unit))
    return (
        F.when(hours.isNull(), None).when(hours < 1 / 60, "just now").when(hours < 1, F.concat(F.round(hours * 60).cast("long").cast("string"), F.lit("m")))
        .when(hours < 24, out("h", 1)).when(hours < 168, out("d", 24)).when(hours < 720, out("w", 168)).when(hours < 8760, out("mo", 720)).otherwise(out("y", 8760))
    )


def parse_count(c: Column) -> Column:
    """`1,234`, `1.2K`, `3M` or `12 comments` as a number; null if there is none. Numbers beyond 64 bits stay at their end."""
    bare = F.replace(c, F.lit(","), F.lit(""))
    n = F.regexp_extract(bare, r"(?i)(\d+(?:\.\d+)?)\s*([km])?", 1)
    unit = F.lower(F.regexp_extract(bare, r"(?i)(\d+(?:\.\d+)?)\s*([km])?", 2))
    value = F.round(n.cast("double") * F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1))
    return F.when(n != "", F.when(value < 2.0**63, value.cast("long")).otherwise(2**63 - 1))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def hash_text(c: Column, units: int = 300) -> Column:
    """djb2 over the first UTF-16 units, as base-36 text."""
    # no more characters than units are cut off first, once, so that the rest of a long text costs nothing
    points = F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(F.substring(c, 1, units), ""), F.ascii))
    pair = lambda p: F.array(F.lit(55296) + F.shiftright(p - 65536, 10), F.lit(56320) + (p - 65536).bitwiseAND(1023))
    wide = lambda ps: F.slice(F.flatten(F.transform(ps, lambda p: F.when(p < 65536, F.array(p)).otherwise(pair(p)))), 1, units)
    code = let(points, lambda ps: F.when(F.exists(ps, lambda p: p > 65535), wide(ps)).otherwise(ps))
    h = F.aggregate(code, F.lit(5381).cast("bigint"), lambda acc, u: (acc * 33 + u).bitwiseAND(4294967295))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def sha256_id(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def score_key(model: str, kind: str, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(kind), text))


def stable_split(text: Column, given: Column | None = None) -> Column:
    """The given split, else `test` for a fifth of the texts by their hash."""
    by_hash = F.when(F.conv(F.substring(F.sha1(text), 1, 2), 16, 10).cast("int") % 5 == 0, "test").otherwise("dev")
    return by_hash if given is None else F.coalesce(F.when(given != "", given), by_hash)


def redact_emails(c: Column) -> Column:
    """Emails by kind of domain. Domains are marked first, so that chained addresses are told apart."""
    mark = "\x01"
    free = "|".join(d.replace(".", r"\.") for d in L.FREE_EMAIL_DOMAINS)
    out = F.regexp_replace(c, java(L.EMAIL.replace("@[", "@([") + ")"), f"{mark}$1{mark}")
    out = F.regexp_replace(out, rf"(?i){mark}(?:[^{mark}]*\.)?(?:{free}){mark}", "[email:free]")
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(out, f"{mark}[^{mark}]*{mark}", "[email:company]")).otherwise(c)


def redact_contacts(c: Column) -> Column:
    """Profile links, emails and phone numbers of eight digits or more replaced by tags."""
    phone = r"\+?(?=(?:[\s()-]*\d){8})\d[\d\s()-]{7,}\d"
    return F.regexp_replace(redact_emails(F.regexp_replace(c, java(L.PROFILE), "[profile]")), java(phone), "[phone]")


def name_parts(names: Column) -> Column:
    """Full names and their capitalised words of three letters or more, longest first."""
    full = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.length(n) >= 2)
    words = F.flatten(F.transform(full, lambda n: F.filter(F.split(n, java(r"\s+", False)), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{Lu}"))))
    every = F.array_distinct(F.concat(full, words))
    return F.transform(F.array_sort(F.transform(every, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])


def anonymize(c: Column, names: Column) -> Column:
    """Contacts, then the given people's names, replaced by tags."""
    quote = lambda p: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), p, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.aggregate(F.coalesce(name_parts(names), F.array().cast("array<string>")), redact_contacts(c), lambda acc, p: F.regexp_replace(acc, quote(p), F.lit("[name]")))
