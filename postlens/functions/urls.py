"""URL, domain and email primitives as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .hosts import canonical_host, over, without_dots
from .text import holds, java, let, strings

#: The patterns in Java's dialect, without going back into a run of characters that can't be followed by what comes next.
#: An address begins where a run of its characters does, or where the last match ended.
EMAIL = java(L.EMAIL).replace("[A-Z0-9._%+-]+@", r"(?:(?<![A-Z0-9._%+-])|\G)[A-Z0-9._%+-]++@")
URL = java(L.URL).replace("[a-z0-9-]+", "[a-z0-9-]++")

REST = r"(?i)^https?:[/\\]*(?:[^/\\?#]*@)?([^/\\?#:@]+)(?::(\d{0,5}))?(?=[/\\?#]|$)([^?#]*)"


def host_matches(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def suffixes(host: Column) -> Column:
    """`a.b.co` -> `a.b.co`, `b.co`, `co`."""
    return let(F.split(host, r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def in_domain_list(host: Column, domains: Sequence[str]) -> Column:
    return host.rlike(domain_pattern(domains))


def domain_pattern(domains: Sequence[str]) -> str:
    return r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in dict.fromkeys(domains)) + r")\z"


def find_domain(host: Column, path: Column, entries: Sequence[tuple[str, str, str]]) -> Column:
    """Name of the first entry whose domain (and path prefix, if it has one) fits."""
    domains, prefixes, names = (strings(x) for x in zip(*entries))
    fits = lambda d, i: ((host == d) | host.endswith(F.concat(F.lit("."), d))) & F.lower(path).startswith(F.get(prefixes, i))
    # names of the domains that fit; most hosts fit none, which one pattern tells
    found = F.filter(F.transform(domains, lambda d, i: F.when(fits(d, i), F.get(names, i))), lambda n: n.isNotNull())
    return F.when(in_domain_list(host, [e[0] for e in entries]), F.get(found, F.lit(0)))


def registrable_label(host: Column) -> Column:
    """`careers.acme.co.in` -> `acme`; null for a bare suffix."""
    h = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.$", "")
    many = F.coalesce(*[F.when(h.endswith("." + s), F.substring(h, F.lit(1), F.length(h) - len(s) - 1)) for s in L.MULTI_PART_SUFFIXES])
    rest = F.coalesce(many, F.regexp_replace(h, r"(^|\.)[^.]*$", ""))
    return F.nullif(F.element_at(F.split(rest, r"\."), -1), F.lit(""))


def parse_once(raw: Column) -> Column:
    """struct(host, path, query) of a raw link, or null: it must hold a dot and no white space, and its host must be one."""
    return let(F.regexp_replace(raw, java(r"^\s+|\s+$", False), ""), lambda t: let(F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t)), lambda url: let(canonical_host(F.regexp_extract(url, REST, 1)), lambda host: _checked(t, url, host))))


def _checked(t: Column, url: Column, host: Column) -> Column:
    port = F.regexp_extract(url, REST, 2)
    ok = host.isNotNull() & F.contains(t, F.lit(".")) & ~t.rlike(java(r"\s", False)) & ((port == "") | (port.cast("int") <= 65535))
    path = F.replace(F.regexp_extract(url, REST, 3), F.lit("\\"), F.lit("/"))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(host.alias("host"), F.when(path == "", "/").otherwise(without_dots(path)).alias("path"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query")))


#: The least length of a redirect page's address with an empty link in it.
LEAST_WRAPPER = 25


def parse_url(raw: Column) -> Column:
    """As parse_once, but links through a network's own redirect page are unwrapped, however often they are wrapped."""

    def inner(r: Column) -> Column:
        """The link in a redirect page's address, which needs no more of parsing than this."""
        t = F.regexp_replace(r, java(r"^\s+|\s+$", False), "")
        url = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
        host = F.lower(F.regexp_extract(url, REST, 1))
        path = without_dots(F.replace(F.regexp_extract(url, REST, 3), F.lit("\\"), F.lit("/")))
        wrapped = host_matches(host, "linkedin.com") & path.rlike(r"^/(redir/redirect|safety/go)") & ~t.rlike(java(r"\s", False))
        return F.when(wrapped, F.try_url_decode(F.nullif(F.regexp_extract(url, r"^[^#?]*\?(?:[^#]*&)?url=([^&#]*)", 1), F.lit(""))))

    levels = F.sequence(F.lit(1), over(F.length(raw).cast("long"), LEAST_WRAPPER).cast("int") + 1)
    last = F.aggregate(levels, raw, lambda acc, _: F.coalesce(inner(acc), acc))
    maybe = F.coalesce(F.lower(raw).rlike("/(redir/redirect|safety/go)"), F.lit(False)) | F.contains(raw, F.lit("/."))
    return parse_once(F.when(maybe, last).otherwise(raw))


def url_key(u: Column) -> Column:
    return F.concat(F.regexp_replace(u["host"], r"^www\.", ""), F.regexp_replace(u["path"], "/$", ""))


def may_hold(text: Column, low: Column | None, patterns: Sequence[str]) -> Column:
    """Whether the text holds what one of the patterns needs. low: the text in lower case, if that is there already."""
    one = lambda x: reduce(or_, [holds(x, L.NEEDED[p]) for p in patterns])
    return let(F.lower(text), one) if low is None else one(low)


#: What a word of the text must hold for an address or a link, neither of which holds a space, to be in it.
IN_WORD: dict[str, Callable[[Column], Column]] = {L.EMAIL: lambda w: F.contains(w, F.lit("@")), L.URL: lambda w: F.contains(w, F.lit("/")) | (F.contains(w, F.lit(".")) & w.rlike(r"(?i)www\."))}


def words_with(text: Column, pattern: str) -> Column:
    """The words between spaces that a match of the pattern may be in: a few of a long text."""
    return F.array_join(F.filter(F.split(text, " "), IN_WORD[pattern]), " ")


def without(text: Column, pattern: str, java_pattern: str) -> Column:
    """The text with a space for each match, sought word by word."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(IN_WORD[pattern](w), F.regexp_replace(w, java_pattern, " ")).otherwise(w)), " ")


def all_if(text: Column, pattern: str, java_pattern: str, low: Column | None = None) -> Column:
    """All matches' first groups; searched for only where the text holds what the pattern needs."""
    found = F.regexp_extract_all(words_with(text, pattern) if pattern in IN_WORD else text, F.lit(java_pattern), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), None).when(may_hold(text, low, [pattern]), found).otherwise(none) if pattern in L.NEEDED else found


def bare_urls(text: Column, low: Column | None = None) -> Column:
    return all_if(text, L.URL, f"({URL})", low)


def is_careers_link(u: Column) -> Column:
    """Whether a subdomain or a path segment hints at a careers page."""
    labels = F.split(u["host"], r"\.")
    subdomains = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
    return F.arrays_overlap(F.concat(subdomains, F.split(F.lower(u["path"]), r"[/_.]+")), strings(L.CAREERS_HINTS))


def text_emails(text: Column, low: Column | None = None) -> Column:
    return all_if(text, L.EMAIL, f"({EMAIL})", low)


def email_domains(emails: Column, text: Column, low: Column | None = None) -> Column:
    """Distinct lower-case domains of listed emails, then of those in the text; null for what has no @."""
    every = F.concat(F.coalesce(emails, F.array().cast("array<string>")), text_emails(text, low))
    return F.array_distinct(F.filter(F.transform(every, lambda e: F.lower(F.get(F.split(e, "@"), 1))), lambda d: d.isNotNull()))


def without_contacts(text: Column, low: Column | None = None) -> Column:
    bare = F.when(may_hold(text, low, [L.EMAIL]), without(text, L.EMAIL, EMAIL)).otherwise(text)
    return F.when(may_hold(text, low, [L.URL]), without(bare, L.URL, URL)).otherwise(bare)


def has_contacts(text: Column, low: Column | None = None) -> Column:
    """False where without_contacts() surely changes nothing."""
    return F.coalesce(may_hold(text, low, [L.EMAIL, L.URL]), F.lit(False))


def company_candidates(text: Column, low: Column | None = None) -> Column:
    """Capitalised names that phrasing such as "at Acme" or "Acme is hiring" points at."""
    found = F.concat(*[all_if(text, p, java(p, False), low) for p in L.COMPANY])
    stop = strings(L.COMPANY_STOPWORDS)

    def clean(name: Column) -> Column:
        words = F.split(F.regexp_replace(name, r"[.'-]+$", ""), java(r"\s+", False))
        kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & F.array_contains(stop, F.lower(w)), acc).otherwise(F.array_append(acc, w)))
        return F.array_join(kept, " ")

    return F.array_distinct(F.filter(F.transform(found, clean), lambda c: F.length(c) >= 2))
