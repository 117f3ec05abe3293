"""Unicode compatibility composition (NFKC) as Column expressions.

The tables are built from the standard library's character data. Most texts hold no
character that the normal form forbids or may join, which one hash intersection tells;
they pass unchanged. In others, such characters are replaced by their full compatibility
decompositions, one replacement for each distinct one, and clusters of a character with
marks (or of Hangul letters) are put into canonical order and composed by a fold.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strings

#: Fixed values of Hangul composition: first letters, vowels, final letters, syllables.
L_BASE, V_BASE, T_BASE, S_BASE, L_COUNT, V_COUNT, T_COUNT = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


@cache
def decompositions() -> dict[str, str]:
    """Every character whose full compatibility decomposition differs from it, syllables of Hangul aside."""
    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not S_BASE <= c < S_BASE + L_COUNT * V_COUNT * T_COUNT)
    return {c: d for c in every if (d := unicodedata.normalize("NFKD", c)) != c}


@cache
def pairs() -> dict[str, str]:
    """Two characters that compose -> the one they make."""
    out = {}
    for c in decompositions():
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and len(d.split()) == 2:
            two = "".join(chr(int(x, 16)) for x in d.split())
            if unicodedata.normalize("NFC", two) == c:
                out[two] = c
    return out


@cache
def marks() -> dict[str, int]:
    """Combining class of each character that has one, 0 for those without that may be second in a pair."""
    out = {p[1]: 0 for p in pairs()}
    return out | {chr(c): k for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (k := unicodedata.combining(chr(c)))}


@cache
def odd() -> list[str]:
    """Characters after which a text may not be in normal form."""
    return [c for c in decompositions() if unicodedata.normalize("NFKC", c) != c] + list(marks()) + [chr(c) for c in [*range(V_BASE, V_BASE + V_COUNT), *range(T_BASE + 1, T_BASE + T_COUNT)]]


@cache
def plain_latin() -> str:
    """A character class of the letters of Latin scripts that are never odd: most texts hold nothing else."""
    strange = set(odd())
    return ranges([chr(c) for c in range(0x250) if chr(c) not in strange])


def ranges(chars: list[str]) -> str:
    """A character class for a regular expression."""
    out, codes = [], sorted(map(ord, chars))
    at = 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(rf"\x{{{codes[at]:X}}}-\x{{{codes[end]:X}}}")
        at = end + 1
    return "".join(out)


@cache
def cluster() -> str:
    m = ranges(list(marks()))
    l, v, t = (rf"[\x{{{a:X}}}-\x{{{b:X}}}]" for a, b in ((L_BASE, L_BASE + L_COUNT - 1), (V_BASE, V_BASE + V_COUNT - 1), (T_BASE + 1, T_BASE + T_COUNT - 1)))
    s = rf"[\x{{{S_BASE:X}}}-\x{{{S_BASE + L_COUNT * V_COUNT * T_COUNT - 1:X}}}]"
    return rf"(?s)(?:{l}{v}{t}?|{s}{t}|[^{m}])[{m}]*|[{m}]+"


def table(d: dict[str, str]) -> Column:
    return F.map_from_arrays(strings(list(d)), strings(list(d.values())))


def code(c: Column) -> Column:
    return F.ascii(c)


def chars_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def character(n: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def hangul(chars: Column) -> Column:
    """The syllable at the beginning of a cluster's characters, and how many of them it takes (0 if there is none)."""
    a, b, c = (F.coalesce(code(F.get(chars, F.lit(k))), F.lit(0)) for k in range(3))
    within = lambda x, base, n: (x >= base) & (x < base + n)
    final = lambda x: within(x, T_BASE + 1, T_COUNT - 1)
    lv = S_BASE + ((a - L_BASE) * V_COUNT + (b - V_BASE)) * T_COUNT
    is_lv = within(a, L_BASE, L_COUNT) & within(b, V_BASE, V_COUNT)
    open_syllable = within(a, S_BASE, L_COUNT * V_COUNT * T_COUNT) & ((a - S_BASE) % T_COUNT == 0) & final(b)
    made = F.when(is_lv & final(c), F.struct((lv + c - T_BASE).alias("s"), F.lit(3).alias("n"))).when(is_lv, F.struct(lv.alias("s"), F.lit(2).alias("n"))).when(open_syllable, F.struct((a + b - T_BASE).alias("s"), F.lit(2).alias("n")))
    return F.coalesce(made, F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")))


def composed_cluster(c: Column) -> Column:
    """A cluster in canonical order, composed."""
    classes = table({k: str(v) for k, v in marks().items()})
    joins = table(pairs())

    def fold(chars: Column) -> Column:
        with_class = F.transform(chars, lambda x: F.struct(F.coalesce(F.element_at(classes, x).cast("int"), F.lit(0)).alias("k"), x.alias("x")))

        def ordered(cs: Column) -> Column:
            # a mark never moves over a character of class 0: it belongs to the run that this begins
            run = lambda i: F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda y: y["k"] == 0))
            keyed = F.transform(cs, lambda y, i: F.struct(run(i).alias("run"), y["k"].alias("k"), i.alias("i"), y["x"].alias("x")))
            # out: what is done; s: the starter that still takes marks; rest: marks after it; last: class of the last of them
            start = F.struct(F.lit("").alias("out"), F.lit("").alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))

            def step(acc: Column, y: Column) -> Column:
                joined = F.element_at(joins, F.concat(acc["s"], y["x"]))
                free = (acc["s"] != "") & F.when(acc["rest"] == "", F.lit(True)).otherwise((acc["last"] < y["k"]) & (acc["last"] > 0))
                taken = F.struct(acc["out"].alias("out"), joined.alias("s"), acc["rest"].alias("rest"), acc["last"].alias("last"))
                new = F.struct(F.concat(acc["out"], acc["s"], acc["rest"]).alias("out"), y["x"].alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))
                kept = F.struct(acc["out"].alias("out"), acc["s"].alias("s"), F.concat(acc["rest"], y["x"]).alias("rest"), y["k"].alias("last"))
                return F.when(free & joined.isNotNull(), taken).when(y["k"] == 0, new).otherwise(kept)

            end = F.aggregate(F.array_sort(keyed), start, step)
            return let(end, lambda e: F.concat(e["out"], e["s"], e["rest"]))

        return let(with_class, ordered)

    def with_syllable(chars: Column) -> Column:
        joined = lambda h: F.when(h["n"] > 0, F.concat(F.array(character(h["s"])), F.slice(chars, h["n"] + 1, F.size(chars)))).otherwise(chars)
        return let(let(hangul(chars), joined), fold)

    return F.when(F.length(c) < 2, c).otherwise(let(chars_of(c), with_syllable))


def nfkc(text: Column) -> Column:
    """Compatibility composition; null stays null, text of common Latin letters passes at once."""
    replaced = table(decompositions())

    def compose(t: Column) -> Column:
        there = F.array_intersect(strings(odd()), F.array_distinct(chars_of(t)))

        def rewritten(some: Column) -> Column:
            special = F.array_intersect(strings(list(decompositions())), F.array_distinct(chars_of(t)))
            plain = F.aggregate(special, t, lambda acc, x: F.replace(acc, x, F.element_at(replaced, x)))
            joined = let(plain, lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(cluster()), F.lit(0)), composed_cluster), ""))
            return F.when(F.size(some) == 0, t).otherwise(joined)

        return let(there, rewritten)

    return F.when(text.rlike(f"[^{plain_latin()}]"), let(text, compose)).otherwise(text)
