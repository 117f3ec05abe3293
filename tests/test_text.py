import pytest
from pyspark.sql import functions as F

from postlens.functions import lexicon as L
from postlens.functions import text as T
from postlens.functions import urls as U


def values(spark, cases, expr, kind="string"):
    """expr over each distinct input, in the order of cases."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", expr(F.col("x")).alias("v")).collect())]


#: Every unit in its short, middle and long name, with what may stand around it.
AGES = {f"{n}{gap}{unit}{tail}": n * hours for (unit, hours), n, gap, tail in zip(L.UNIT_HOURS.items(), range(2, 99), ["", " "] * 20, ["", " ago", " •"] * 9, strict=False)}
AGES |= {"7 days": 168, "11 weeks ago": 1848, "4 months": 2880, "13 hrs": 13, "just now": 0, "Now": 0, "": None, "hours": None, "9 parsecs": None}


def test_parse_age(spark):
    got = values(spark, list(AGES), T.parse_age_hours)
    assert got == [None if v is None else pytest.approx(v) for v in AGES.values()]


def test_format_age(spark):
    assert values(spark, [0.01, 0.25, 23.4, 100.0, 500.0, 3000.0, 20000.0, None], T.format_age, "double") == ["just now", "15m", "23h", "4d", "3w", "4mo", "2y", None]


def test_parse_count(spark):
    assert values(spark, ["7", "20,481", "6.4k", "2M", "0.5 m", "31 reactions", "", None, "many"], T.parse_count) == [7, 20481, 6400, 2_000_000, 500_000, 31, None, None, None]


def test_counts_beyond_64_bits(spark):
    # more digits than a long holds stay at its end: a number anywhere in a feed page must not fail the job
    ends = ["4413361509902647713792 likes", "9,223,372,036,854,775,807", "9".ljust(400, "9") + " comments", "9000000000000000000m"]
    assert values(spark, [*ends, "9007199254740992"], T.parse_count) == [2**63 - 1] * 4 + [2**53]


def test_flatten_and_composition(spark):
    assert values(spark, ["  We're HIRING!! C++ ", ""], T.flatten) == [" we re hiring c++ ", "  "]
    # lower-casing comes before composition, so a mathematical capital stays one
    assert values(spark, ["𝗛iring"], lambda c: T.flatten(c, True)) == [" Hiring "]


@pytest.mark.parametrize("name", ["HIRING_KEYWORDS", "SEEKER_PHRASES", "NOT_HIRING_PHRASES", "BAIT_PHRASES", "WEAK_BAIT_WORDS", "DM_PHRASES", "JOB_CONTEXT_WORDS", "SCAM_PHRASES", "TECH_TERMS", "ROLE_TERMS", "LOCATION_TERMS"])
def test_phrases_match_themselves(spark, name):
    phrases = getattr(L, name)
    assert len(set(phrases)) == len(phrases)
    hits = values(spark, [f"So, {p.upper()}!" for p in phrases], lambda c: T.find_phrases(T.flatten(c), phrases))
    assert all(p in h for p, h in zip(phrases, hits, strict=True))


def test_patterns(spark):
    any_of = lambda ps: lambda c: T.matches_any(c, ps)
    assert values(spark, ["earning upto usd 40 per hour", "Rs. 1,500 / day, food", "we make a Daily  Payout", "EARN FROM HOME", "paid by the day"], any_of([p for p, _ in L.PAY_CLAIMS])) == [True] * 4 + [False]
    assert values(spark, ["stipend", "8 LPA", "€ 70", "INR 4000", "per  annum", "xlpa", "éctc", "salaries"], any_of(L.SALARY)) == [True] * 5 + [False, True, False]
    assert values(spark, ["10yoe", "1 to 3 years", "fresher", "experience - none", "entry-level", "experienced", "years"], any_of(L.EXPERIENCE)) == [True] * 5 + [False] * 2


def test_hash_text(spark):
    def djb2(t):
        h, units = 5381, t.encode("utf-16-be")
        for i in range(0, min(len(units), 600), 2):
            h = (h * 33 + units[i] * 256 + units[i + 1]) % 2**32
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out or "0"

    cases = ["", "a", "Hello, world", "😀é" * 200, "x" * 1000]
    assert values(spark, cases, T.hash_text) == [djb2(c) for c in cases]


def test_hash_text_reads_no_more_than_its_units(spark):
    import time

    def took(size):
        text = spark.range(400).select(F.concat(F.col("id").cast("string"), F.lit("long text " * size)).alias("t")).localCheckpoint()
        began = time.time()
        text.agg(F.max(T.hash_text(F.col("t")))).collect()
        return time.time() - began

    took(40)
    assert took(20_000) < 5 * took(40) + 3
    cases = ["a" * 299 + "😀", "a" * 298 + "😀😀", "é\x00\n" * 150]
    assert len(set(values(spark, cases, T.hash_text))) == 3
    # a pair cut in half by the limit counts with its first half, as in UTF-16
    assert values(spark, ["a" * 299 + "😀", "a" * 299 + "😁"], T.hash_text) == [values(spark, ["a" * 299 + "😀x"], T.hash_text)[0]] * 2


def test_redaction(spark):
    cases = {
        "x@sub.gmail.com,y@nimbus.io;": "[email:free],[email:company];", "no digits to call: 12 34 56": "no digits to call: 12 34 56", "ring (030) 44-55-66-7 today": "ring ([phone] today",
        "de.linkedin.com/in/kim-lee?x=1 (https://linkedin.com/in/ö) linkedin.com/company/q": "[profile] ([profile]) linkedin.com/company/q", "q@w.org@yahoo.com": "[email:company]@yahoo.com", "card 4000 1234 5678 9010": "card [phone]",
    }
    assert values(spark, list(cases), T.redact_contacts) == list(cases.values())


def test_names(spark):
    rows = spark.createDataFrame([("Ole Lund, Lund & Olesen: ask ole or Ole.", ["Ole Lund"]), ("Mia-Sofie wrote to Max (at Maxwell)", ["Max", " Mia-Sofie ", "x"]), ("a.b (c)", ["a.b", "(c)"]), ("none", None)], "t string, n array<string>")
    assert [r[0] for r in rows.select(T.anonymize(F.col("t"), F.col("n"))).collect()] == ["[name], [name] & Olesen: ask ole or [name].", "[name] wrote to [name] (at Maxwell)", "[name] [name]", "none"]


def test_urls(spark):
    cases = {
        "https://WWW.Example.com/a?b#c": ("www.example.com", "/a"), "example.com": ("example.com", "/"), "no dots": None, "mailto:jobs@quillon.in": ("quillon.in", "/"), "": None,
        "https://www.linkedin.com/redir/redirect?url=https%3A%2F%2Fapply.workable.com%2Fx&t=1": ("apply.workable.com", "/x"), "v1.2": None, "a.b:99999/x": None, "a.b:80/x": ("a.b", "/x"),
    }
    got = values(spark, list(cases), lambda c: U.parse_url(c))
    assert [None if g is None else (g.host, g.path) for g in got] == list(cases.values())


def test_registrable_label(spark):
    assert values(spark, ["careers.acme.co.in", "www.acme.com", "acme.io.", "com", "a.b.co.uk"], U.registrable_label) == ["acme", "acme", "acme", None, "b"]


def test_label_in_tokens(spark):
    rows = spark.createDataFrame([("acmelabs", ["at", "acme", "labs"]), ("acme-labs", ["acme", "labs"]), ("ab", ["ab"]), ("abc", []), ("abcd", ["a", "b", "c", "d"])], "l string, t array<string>")
    assert [r[0] for r in rows.select(T.label_in_tokens(F.col("l"), F.col("t"))).collect()] == [True, True, False, False, False]


def test_company_candidates(spark):
    assert values(spark, ["Ask at Orchid Works, as Quillon is growing", "We are at The Office", "nothing"], U.company_candidates) == [["Orchid Works", "Quillon"], ["Office"], []]
