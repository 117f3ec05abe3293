"""What a URL parser makes of hosts and paths, as Column expressions: dot segments, IPv4 numbers, labels beyond ASCII.

Each is a fold over the parts of a string, and is only tried where the string holds
something it would change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Fixed values of the bootstring encoding for host names.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def over(a: Column, b: Column | int) -> Column:
    """Whole-number division of numbers that are not negative."""
    return ((a - a % b) / b).cast("long")


def without_dots(path: Column) -> Column:
    """The path with `.` and `..` segments resolved, percent-encoded dots among them."""
    dotted = F.lower(path).rlike(r"(^|/)(\.|%2e){1,2}(/|$)")
    none = F.array().cast("array<string>")

    def fold(segments: Column) -> Column:
        marked = F.transform(segments, lambda s, i: F.struct(s.alias("s"), F.regexp_replace(F.lower(s), "%2e", ".").alias("dots"), (i == F.size(segments) - 1).alias("last")))

        def step(acc: Column, x: Column) -> Column:
            up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            end = lambda a: F.when(x["last"], F.array_append(a, F.lit(""))).otherwise(a)
            return F.when(x["dots"] == "..", end(up)).when(x["dots"] == ".", end(acc)).otherwise(F.array_append(acc, x["s"]))

        return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, none, step), "/"))

    return F.when(F.coalesce(dotted, F.lit(False)), let(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), fold)).otherwise(path)


def ends_in_number(host: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), -1)
    return F.coalesce(last.rlike(r"^(\d+|0x[0-9a-f]*)$"), F.lit(False))


def ipv4(host: Column) -> Column:
    """`a.b.c.d` of up to four numbers, decimal, octal (0...) or hexadecimal (0x...), the last filling the bytes that are left; null if there is no such address."""

    def number(p: Column) -> Column:
        long = F.length(p) > 24
        return (
            F.when(long, None).when(p.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(p, F.lit(3), F.length(p)), 16, 10)).when(p == "0x", "0")
            .when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]*)$"), p)
        ).cast("decimal(24,0)")

    def address(parts: Column) -> Column:
        n = F.size(parts)
        last = F.get(parts, n - 1)
        room = F.element_at(F.array(*[F.lit(256 ** (5 - k)).cast("decimal(24,0)") for k in range(1, 5)]), F.least(n, F.lit(4)))
        fine = (n <= 4) & ~F.exists(parts, lambda p: p.isNull()) & (last < room) & ~F.exists(F.slice(parts, F.lit(1), n - 1), lambda p: p > 255)
        high = F.aggregate(F.slice(parts, F.lit(1), n - 1), F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))
        whole = high * F.element_at(F.array(*[F.lit(256 ** (5 - k)) for k in range(1, 5)]), F.least(n, F.lit(4))) + last.cast("long")
        dotted = let(whole, lambda w: F.concat_ws(".", *[over(w % 256 ** (k + 1), 256**k).cast("string") for k in (3, 2, 1, 0)]))
        return F.when(F.coalesce(fine, F.lit(False)), dotted)

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), address)


def threshold(k: Column, bias: Column) -> Column:
    return F.when(k <= bias, T_MIN).when(k >= bias + T_MAX, T_MAX).otherwise(k - bias)


def digit(d: Column) -> Column:
    return F.substring(F.lit(DIGITS), d.cast("int") + 1, F.lit(1))


def variable_length(delta: Column, bias: Column) -> Column:
    """A delta in digits whose weights depend on the bias; 13 digits hold any delta of a long."""
    start = F.struct(delta.alias("q"), F.lit(False).alias("done"), F.lit("").alias("s"))

    def step(acc: Column, i: Column) -> Column:
        def with_t(t: Column) -> Column:
            last = F.struct(acc["q"].alias("q"), F.lit(True).alias("done"), F.concat(acc["s"], digit(acc["q"])).alias("s"))
            more = F.struct(over(acc["q"] - t, F.lit(BASE) - t).alias("q"), F.lit(False).alias("done"), F.concat(acc["s"], digit(t + (acc["q"] - t) % (F.lit(BASE) - t))).alias("s"))
            return F.when(acc["q"] < t, last).otherwise(more)

        return F.when(acc["done"], acc).otherwise(let(threshold(i * BASE, bias).cast("long"), with_t))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(13).cast("long")), start, step)["s"]


def adapted(delta: Column, points: Column, first: Column) -> Column:
    def halved(d: Column) -> Column:
        start = F.struct((d + over(d, points)).alias("d"), F.lit(0).cast("long").alias("k"))
        most = (BASE - T_MIN) * T_MAX // 2
        step = lambda acc, _: F.when(acc["d"] > most, F.struct(over(acc["d"], BASE - T_MIN).alias("d"), (acc["k"] + BASE).alias("k"))).otherwise(acc)
        end = F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, step)
        return let(end, lambda e: e["k"] + over((BASE - T_MIN + 1) * e["d"], e["d"] + SKEW))

    return let(F.when(first, over(delta, DAMP)).otherwise(over(delta, 2)), halved)


def encoded_label(label: Column) -> Column:
    """`bücher` -> `xn--bcher-kva`; labels of ASCII stay."""

    def encode(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.ascii(c).cast("long"))

        def with_codes(cps: Column) -> Column:
            basic = F.filter(chars, lambda c: F.ascii(c) < FIRST_CODE)
            b = F.size(basic).cast("long")
            start = F.struct(F.lit(0).cast("long").alias("delta"), F.lit(FIRST_CODE).cast("long").alias("n"), b.alias("h"), F.lit(FIRST_BIAS).cast("long").alias("bias"), F.lit("").alias("out"))

            def one_code(acc: Column, m: Column) -> Column:
                at = F.struct((acc["delta"] + (m - acc["n"]) * (acc["h"] + 1)).alias("delta"), acc["h"].alias("h"), acc["bias"].alias("bias"), acc["out"].alias("out"))

                def char(x: Column, c: Column) -> Column:
                    new = F.struct(F.lit(0).cast("long").alias("delta"), (x["h"] + 1).alias("h"), adapted(x["delta"], x["h"] + 1, x["h"] == b).alias("bias"), F.concat(x["out"], variable_length(x["delta"], x["bias"])).alias("out"))
                    less = F.struct((x["delta"] + 1).alias("delta"), x["h"].alias("h"), x["bias"].alias("bias"), x["out"].alias("out"))
                    return F.when(c == m, new).when(c < m, less).otherwise(x)

                return let(F.aggregate(cps, at, char), lambda e: F.struct((e["delta"] + 1).alias("delta"), (m + 1).alias("n"), e["h"].alias("h"), e["bias"].alias("bias"), e["out"].alias("out")))

            codes_beyond = F.array_sort(F.array_distinct(F.filter(cps, lambda c: c >= FIRST_CODE)))
            made = F.aggregate(codes_beyond, start, one_code)["out"]
            return F.concat(F.lit("xn--"), F.array_join(basic, ""), F.when(F.size(basic) > 0, "-").otherwise(""), made)

        return let(codes, with_codes)

    return F.when(label.rlike(r"^\p{ASCII}*$"), label).otherwise(let(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), encode))


def canonical_host(host: Column) -> Column:
    """A host as a URL holds it: percent-decoded, in lower case, labels in ASCII, numbers as an IPv4 address; null if it can't be one.

    Compatibility forms of letters are not folded into others before they are encoded.
    """
    decoded = F.when(F.contains(host, F.lit("%")), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    low = F.translate(F.lower(decoded), "。．｡", "...")
    ascii_host = lambda h: F.when(h.rlike(r"^\p{ASCII}*$"), h).otherwise(F.array_join(F.transform(F.split(h, r"\."), encoded_label), "."))
    final = lambda h: F.when(ends_in_number(h), ipv4(h)).when((h != "") & ~h.rlike(r"[\x00-\x20\x7F#/:<>?@\[\]\\^|%]"), h)
    return let(low, lambda h: let(ascii_host(h), final))
