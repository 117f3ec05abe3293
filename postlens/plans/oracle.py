"""The checked queries again, as DuckDB SQL that computes everything from the tables."""

from __future__ import annotations

from ..functions import lexicon as L
from .posts import TEMPLATES


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def ls(items: list[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def hits(items: list[str]) -> str:
    return f"list_filter({ls(items)}, lambda p: contains(flat, ' ' || p || ' '))"


def has(items: list[str]) -> str:
    return f"len({hits(items)}) > 0"


def any_match(patterns: list[str], c: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {q('(?i)' + p)})" for p in patterns) + ")"


def flat(c: str) -> str:
    return rf"' ' || trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}+]+', ' ', 'g')) || ' '"


def fits(host: str, d: str) -> str:
    return f"({host} = {q(d)} OR ends_with({host}, {q('.' + d)}))"


def in_list(host: str, domains: list[str]) -> str:
    return "(" + " OR ".join(fits(host, d) for d in domains) + ")"


def entry(host: str, path: str, entries: list[tuple[str, str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {fits(host, d)}" + (f" AND starts_with(lower({path}), {q(p)})" if p else "") + f" THEN {q(n)}" for d, p, n in entries) + " END"


def label(host: str) -> str:
    h = rf"regexp_replace(regexp_replace(lower({host}), '^www\.', ''), '\.$', '')"
    many = " ".join(f"WHEN ends_with({h}, {q('.' + s)}) THEN left({h}, len({h}) - {len(s) + 1})" for s in L.MULTI_PART_SUFFIXES)
    rest = rf"CASE {many} ELSE regexp_replace({h}, '(^|\.)[^.]*$', '') END"
    return f"nullif(split_part({rest}, '.', -1), '')"


def in_tokens(lab: str, toks: str) -> str:
    plain = f"regexp_replace(lower({lab}), '[^a-z0-9]', '', 'g')"
    return f"(coalesce(len({plain}) >= 3 AND len(list_filter(range(1, len({toks}) + 1), lambda i: {toks}[i] = {plain} OR coalesce({toks}[i] || {toks}[i + 1] = {plain}, false) OR coalesce({toks}[i] || {toks}[i + 1] || {toks}[i + 2] = {plain}, false))) > 0, false))"


REST = r"(?i)^https?:/*(?:[^/?#]*@)?([^/?#:@]+)(?::\d*)?([^?#]*)"


def url_of(raw: str) -> str:
    return f"CASE WHEN regexp_matches(trim({raw}), '(?i)^https?://') THEN trim({raw}) ELSE 'https://' || trim({raw}) END"


def parsed(raw: str) -> str:
    u = url_of(raw)
    return f"{{'host': lower(regexp_extract({u}, {q(REST)}, 1)), 'path': CASE WHEN regexp_extract({u}, {q(REST)}, 2) = '' THEN '/' ELSE regexp_extract({u}, {q(REST)}, 2) END}}"


BODIES = ",\n".join(f"({k}, {q(b)}, {q(h)}, {q(href)}, {q(t)}, {q(e)})" for k, (b, h, href, t, e) in enumerate(TEMPLATES))

POSTS = f"""WITH templates(k, body, headline, href, link_text, listed_email) AS (VALUES {BODIES}),
posts AS (
  SELECT doc_id, source, body || ' ' || coalesce(d.text, '') AS text, headline, href, link_text, listed_email,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(((doc_id * 7 % 500 + 500) % 500) / 2.0 AS DOUBLE) END AS age_hours,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id * 29 % 320 + 320) % 320 * CASE WHEN doc_id % 4 = 3 THEN 9 ELSE 1 END END AS comments
  FROM documents d JOIN templates ON coalesce((doc_id % {len(TEMPLATES)} + {len(TEMPLATES)}) % {len(TEMPLATES)}, 0) = k),
flats AS (SELECT *, {flat("text")} AS flat, {flat("headline")} AS headline_flat,
  list_filter(list_concat([href, link_text], regexp_extract_all(text, {q("(?i)" + L.URL)})), lambda r: r IS NOT NULL AND contains(r, '.') AND NOT regexp_matches(trim(r), '\\s')) AS raws,
  list_distinct(list_transform(list_concat(CASE WHEN listed_email IS NULL THEN [] ELSE [listed_email] END, regexp_extract_all(text, {q("(?i)" + L.EMAIL)})), lambda e: lower(split_part(e, '@', 2)))) AS domains,
  list_filter(string_split(trim({flat(f"regexp_replace(regexp_replace(text, {q('(?i)' + L.EMAIL)}, ' ', 'g'), {q('(?i)' + L.URL)}, ' ', 'g')")}), ' '), lambda t: t <> '') AS toks
  FROM posts),
once AS (SELECT *, list_filter(string_split(trim(headline_flat), ' '), lambda t: t <> '') AS head_toks,
  list_transform(raws, lambda r: CASE WHEN regexp_matches(r, 'linkedin\\.com/redir/redirect') THEN url_decode(regexp_extract(r, '[?&]url=([^&]*)', 1)) ELSE r END) AS targets FROM flats),
keyed AS (SELECT *, list_transform(targets, lambda r: {parsed("r")}) AS parsed_urls FROM once),
distinct_keys AS (SELECT *, list_transform(parsed_urls, lambda u: regexp_replace(u.host, '^www\\.', '') || regexp_replace(u.path, '/$', '')) AS keys FROM keyed),
with_urls AS (SELECT *, list_filter(parsed_urls, lambda u, i: list_position(keys, regexp_replace(u.host, '^www\\.', '') || regexp_replace(u.path, '/$', '')) = i) AS urls FROM distinct_keys),
kinds AS (SELECT *, list_transform(urls, lambda u: {{'kind': CASE
    WHEN ({entry("u.host", "u.path", L.ATS_DOMAINS)}) IS NOT NULL THEN 'ats' WHEN {fits("u.host", "linkedin.com")} THEN 'internal'
    WHEN ({entry("u.host", "u.path", L.FORM_DOMAINS)}) IS NOT NULL THEN 'form' WHEN {in_list("u.host", L.WHATSAPP_DOMAINS)} THEN 'whatsapp'
    WHEN {in_list("u.host", L.TELEGRAM_DOMAINS)} THEN 'telegram' WHEN {in_list("u.host", L.OPAQUE_LINK_DOMAINS)} THEN 'opaque' WHEN {in_list("u.host", L.SHORTENER_DOMAINS)} THEN 'shortener'
    WHEN list_has_any(list_concat(list_slice(string_split(u.host, '.'), 1, greatest(len(string_split(u.host, '.')) - 2, 0)), regexp_split_to_array(lower(u.path), '[/_.]+')), {ls(L.CAREERS_HINTS)}) THEN 'careers'
    ELSE 'other' END, 'name': {entry("u.host", "u.path", L.ATS_DOMAINS)}, 'label': {label("u.host")}}}) AS kinds FROM with_urls),
signals AS (SELECT *,
  {hits(L.HIRING_KEYWORDS)} AS hiring_hits, {has(L.JOB_CONTEXT_WORDS)} AS job_context, {hits(L.SEEKER_PHRASES)} AS seeker_hits, {hits(L.NOT_HIRING_PHRASES)} AS not_hiring_hits,
  {hits(L.BAIT_PHRASES)} AS bait_hits, {hits(L.WEAK_BAIT_WORDS)} AS weak_bait_hits, {hits(L.SCAM_PHRASES)} AS scam_hits, {any_match([p for p, _ in L.PAY_CLAIMS])} AS pay_claim,
  list_filter(kinds, lambda u: u.kind = 'ats') AS ats, list_filter(kinds, lambda u: u.kind = 'careers') AS careers,
  len(list_filter(kinds, lambda u: u.kind = 'form')) > 0 AS google_form, len(list_filter(kinds, lambda u: u.kind = 'opaque')) AS opaque_links, len(list_filter(kinds, lambda u: u.kind = 'shortener')) AS shortener_links,
  len(list_filter(kinds, lambda u: u.kind = 'whatsapp')) > 0 OR {has(["whatsapp", "whats app"])} AS whatsapp, len(list_filter(kinds, lambda u: u.kind = 'telegram')) > 0 OR {has(["telegram"])} AS telegram,
  list_filter(domains, lambda h: {in_list("h", L.FREE_EMAIL_DOMAINS)}) AS free, list_transform(list_filter(domains, lambda h: NOT {in_list("h", L.FREE_EMAIL_DOMAINS)}), lambda h: coalesce({label("h")}, '')) AS corporate,
  {has(L.DM_PHRASES)} AND len(list_filter(kinds, lambda u: u.kind <> 'internal')) = 0 AND len(domains) = 0 AS dm_only,
  {has(L.ROLE_TERMS)} AS role_title, {any_match(L.EXPERIENCE)} AS experience, {has(L.TECH_TERMS)} AS tech_stack, {has(L.LOCATION_TERMS)} AS location, {any_match(L.SALARY)} AS salary
  FROM kinds),
facts AS (SELECT *, role_title::INT + experience::INT + tech_stack::INT + location::INT + salary::INT AS specificity,
  len(list_filter(careers, lambda u: {in_tokens("u.label", "toks")} OR {in_tokens("u.label", "head_toks")})) > 0 AS careers_page, len(corporate) > 0 AS corporate_email,
  len(list_filter(corporate, lambda c: {in_tokens("c", "toks")} OR {in_tokens("c", "head_toks")})) > 0 AS corporate_matches,
  len(scam_hits) > 0 OR pay_claim AS strong_scam,
  (whatsapp OR telegram)::INT + (shortener_links > 0)::INT + (len(free) > 0 AND len(corporate) = 0)::INT AS weak_scam,
  CASE WHEN comments IS NOT NULL AND age_hours IS NOT NULL THEN comments / greatest(age_hours, 1) END AS per_hour FROM signals),
decided AS (SELECT *, len(ats) > 0 OR careers_page OR corporate_email OR (google_form AND specificity >= {L.FORM_MIN_SPECIFICITY}) OR (opaque_links > 0 AND specificity >= {L.OPAQUE_MIN_SPECIFICITY}) AS genuine,
  CASE WHEN len(seeker_hits) > 0 OR len(not_hiring_hits) > 0 THEN 'not_hiring' WHEN strong_scam AND (len(hiring_hits) > 0 OR job_context) THEN 'hiring' WHEN len(hiring_hits) = 0 THEN 'not_hiring'
    WHEN len(ats) > 0 OR careers_page THEN 'hiring' ELSE 'ask_model' END AS stage1,
  CASE WHEN coalesce(age_hours <= {L.EARLY_MAX_HOURS}, false) AND coalesce(comments, 0) < {L.EARLY_MAX_COMMENTS} THEN 'apply_early'
    WHEN coalesce(comments, 0) >= {L.CROWDED_COMMENTS} OR coalesce(age_hours > {L.CROWDED_HOURS}, false) OR coalesce(per_hour >= {L.CROWDED_PER_HOUR}, false) THEN 'crowded' ELSE 'real_opening' END AS exposure_label FROM facts),
labelled AS (SELECT *, CASE WHEN stage1 = 'not_hiring' THEN 'not_hiring' WHEN strong_scam OR weak_scam >= {L.WEAK_SCAM_SIGNALS} THEN 'scam_risk' WHEN len(bait_hits) > 0 AND NOT genuine THEN 'engagement_bait'
  WHEN genuine THEN exposure_label ELSE 'unverified' END AS label FROM decided)
"""


AGE = "CASE WHEN {h} < 1/60 THEN 'just now' WHEN {h} < 1 THEN CAST(floor({h} * 60 + 0.5) AS BIGINT) || 'm' WHEN {h} < 24 THEN CAST(floor({h} + 0.5) AS BIGINT) || 'h' WHEN {h} < 168 THEN CAST(floor({h} / 24 + 0.5) AS BIGINT) || 'd' WHEN {h} < 720 THEN CAST(floor({h} / 168 + 0.5) AS BIGINT) || 'w' WHEN {h} < 8760 THEN CAST(floor({h} / 720 + 0.5) AS BIGINT) || 'mo' ELSE CAST(floor({h} / 8760 + 0.5) AS BIGINT) || 'y' END"
SAID = "CASE WHEN comments IS NOT NULL THEN format('{:,}', comments) || CASE WHEN comments = 1 THEN ' comment' ELSE ' comments' END END"


def ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def cleaned(name: str) -> str:
    words = f"regexp_split_to_array(regexp_replace({name}, '[.''-]+$', ''), '\\s+')"
    first = f"list_position(list_transform({words}, lambda w: list_contains({ls(L.COMPANY_STOPWORDS)}, lower(w))), false)"
    return f"CASE WHEN {first} > 0 THEN array_to_string(list_slice({words}, {first}, len({words})), ' ') ELSE '' END"


FOUND = "list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in L.COMPANY) + ")"
COMPANIES = f""", named AS (SELECT *, list_filter(list_transform({FOUND}, lambda c: {cleaned("c")}), lambda c: len(c) >= 2) AS every_company FROM labelled),
companies AS (SELECT *, {ordered_distinct("every_company")} AS companies FROM named),
posters AS (SELECT *, len(list_filter(careers, lambda u: {in_tokens("u.label", "head_toks")})) > 0 OR len(list_filter(corporate, lambda c: {in_tokens("c", "head_toks")})) > 0
  OR len(list_filter(companies, lambda c: contains(headline_flat, {flat("c")}))) > 0 AS poster_at_company FROM companies)
"""
SCAM_SAID = "CASE h " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.SCAM_REASONS.items()) + " ELSE 'Mentions ' || h END"
PAY_SAID = "CASE " + " ".join(f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(r)}" for p, r in L.PAY_CLAIMS) + " END"
LABELS = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.LABEL_TEXT.items()) + " END"
CONTACTS = "CASE WHEN whatsapp THEN 'WhatsApp contact' END, CASE WHEN telegram THEN 'Telegram contact' END"
NO_HIRING = "CASE WHEN list_contains(seeker_hits, 'opentowork') THEN 'Job seeker post (#OpenToWork)' WHEN len(seeker_hits) > 0 THEN 'Job seeker post' WHEN len(not_hiring_hits) > 0 THEN 'Personal career update' WHEN len(hiring_hits) = 0 THEN 'No hiring keywords' ELSE 'Reads like a story, advice or update' END"
BAIT = """list_concat(list_transform(list_slice(bait_hits, 1, 2), lambda h: 'Asks you to "' || h || '"'), [CASE WHEN dm_only THEN 'Only "DM me"' WHEN channel IS NULL THEN 'no apply link' END, said])"""
REASONS = COMPANIES + f""", told AS (SELECT *, {AGE.format(h="age_hours")} AS age, {SAID} AS said, list_transform(scam_hits, lambda h: {SCAM_SAID}) AS scam_said,
  CASE WHEN len(ats) > 0 THEN 'Apply link on ' || ats[1].name WHEN careers_page THEN 'Links to company careers page' WHEN corporate_email THEN CASE WHEN corporate_matches THEN 'Company email address' ELSE 'Work email address' END
    WHEN google_form THEN 'Google Form with role details' WHEN opaque_links > 0 THEN 'Apply link with role details' END AS channel FROM posters),
aged AS (SELECT *, CASE WHEN age = 'just now' THEN 'posted just now' WHEN age IS NOT NULL THEN 'posted ' || age || ' ago' END AS posted FROM told),
reasons AS (SELECT *, CASE label WHEN 'not_hiring' THEN [{NO_HIRING}]
  WHEN 'scam_risk' THEN list_concat(list_slice({ordered_distinct("scam_said")}, 1, 2), [{PAY_SAID}, {CONTACTS}, CASE WHEN shortener_links > 0 THEN 'Shortened link' END, CASE WHEN len(free) > 0 AND NOT corporate_email THEN free[1] || ' address' END])
  WHEN 'engagement_bait' THEN {BAIT}
  WHEN 'unverified' THEN [CASE WHEN dm_only THEN 'Only "DM me"' WHEN google_form THEN 'Google Form, few role details' WHEN opaque_links > 0 THEN 'Link destination hidden, few role details' WHEN len(free) > 0 THEN free[1] || ' address only' ELSE 'No apply link or company email' END, {CONTACTS}, posted]
  WHEN 'crowded' THEN [channel, posted, said, CASE WHEN per_hour >= {L.CROWDED_PER_HOUR} THEN 'comments piling up fast' END]
  ELSE [channel, posted, said, CASE WHEN poster_at_company THEN 'poster works there' END] END AS every_reason FROM aged),
lines AS (SELECT *, array_to_string(list_slice(list_filter(every_reason, lambda r: r IS NOT NULL AND r <> ''), 1, {L.MAX_REASONS}), ' · ') AS line FROM reasons)
"""


def posts(select: str) -> str:
    return POSTS + select


FREE_RE = "|".join(d.replace(".", r"\.") for d in L.FREE_EMAIL_DOMAINS)


def without_emails(c: str) -> str:
    """Domains are marked, then told apart."""
    marked = f"regexp_replace({c}, {q('(?i)' + L.EMAIL.replace('@[', '@([') + ')')}, chr(1) || '\\1' || chr(1), 'g')"
    free = f"regexp_replace({marked}, '(?i)' || chr(1) || '(?:[^' || chr(1) || ']*\\.)?(?:{FREE_RE})' || chr(1), '[email:free]', 'g')"
    return f"regexp_replace({free}, chr(1) || '[^' || chr(1) || ']*' || chr(1), '[email:company]', 'g')"


def without_phones(c: str) -> str:
    """Runs of digits and separators are marked; those of eight digits go."""
    marked = f"regexp_replace({c}, '(\\+?\\d[\\d\\s()-]{{7,}}\\d)', chr(2) || '\\1' || chr(3), 'g')"
    phones = f"regexp_replace({marked}, chr(2) || '\\+?\\d(?:[\\s()-]*\\d){{7,}}' || chr(3), '[phone]', 'g')"
    return f"regexp_replace({phones}, '[' || chr(2) || chr(3) || ']', '', 'g')"


GOLD = """WITH g AS (SELECT doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN d.n_chars >= 1500 THEN 'good' ELSE 'bad' END AS pred, least(d.n_chars / 5000.0, 1.0) AS score
FROM labels l JOIN documents d USING (doc_id))"""

PRF = GOLD + """, c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS support, count(*) FILTER (pred = label) AS predicted
FROM g, (VALUES ('good'), ('bad'), ('none')) AS x(label) GROUP BY label),
prf AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf)"""

SWEEP = GOLD + """, grid AS (SELECT CAST(row_number() OVER (ORDER BY h, b) - 1 AS INT) AS grid_ord, h AS t_hiring, b AS t_bait, 0.95 AS t_scam
FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) AS h), (SELECT unnest([0.7, 0.8, 0.9]) AS b)),
p AS (SELECT grid_ord, t_hiring, t_bait, t_scam, gold, CASE WHEN score >= t_hiring AND score < t_bait THEN 'good' ELSE 'bad' END AS pred FROM g, grid),
m AS (SELECT grid_ord, t_hiring, t_bait, t_scam, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy,
  (2.0 * count(*) FILTER (gold = 'good' AND pred = 'good') / (count(*) FILTER (gold = 'good') + count(*) FILTER (pred = 'good'))
   + 2.0 * count(*) FILTER (gold = 'bad' AND pred = 'bad') / (count(*) FILTER (gold = 'bad') + count(*) FILTER (pred = 'bad'))) / 2 AS macro_f1 FROM p GROUP BY ALL)"""
SWEEP_COLUMNS = "grid_ord, t_hiring, t_bait, t_scam, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1"
SWEEP_ORDER = "round(macro_f1, 9) DESC, round(accuracy, 9) DESC, round(t_scam + t_bait, 6) DESC, grid_ord"

SCORED = """, scored AS (SELECT *, CAST('0x' || substr(sha1(text), 1, 4) AS INT) / 65535.0::DOUBLE AS h, CAST('0x' || substr(sha1(text), 5, 4) AS INT) / 65535.0::DOUBLE AS b, CAST('0x' || substr(sha1(text), 9, 4) AS INT) / 65535.0::DOUBLE AS s,
  CASE WHEN regexp_matches(lower(text), 'deposit|bank details|registration fee|per day|/day|payout') THEN 'scam_risk' WHEN regexp_matches(lower(text), 'comment (yes|interested)|repost|follow me') THEN 'engagement_bait'
    WHEN NOT regexp_matches(lower(text), 'hiring|apply|vacancy|resume|join our team') THEN 'not_hiring' WHEN href IS NULL THEN 'unverified' WHEN coalesce(age_hours <= 24, false) AND coalesce(comments, 0) < 50 THEN 'apply_early'
    WHEN coalesce(comments, 0) >= 200 THEN 'crowded' ELSE 'real_opening' END AS gold FROM labelled),
"""


def rounds(source: str, name: str, th: str, tb: str, ts: str, always: bool = False) -> str:
    """The label after two rounds of questions; `always`: all scores are known, whether asked for or not."""
    asks = "true" if always else f"len(text) >= {L.MIN_MODEL_TEXT}"
    yes = "true" if always else "false"
    return f"""{name}1 AS (SELECT *, {asks} AND stage1 = 'ask_model' AS ask_h, stage1 = 'hiring' OR stage1 = 'ask_model' AND (NOT ({asks}) OR h >= {th}) AS is_hiring FROM {source}),
{name}2 AS (SELECT *, {asks} AND is_hiring AND NOT strong_scam AND weak_scam BETWEEN 1 AND {L.WEAK_SCAM_SIGNALS - 1} AS ask_s, {asks} AND is_hiring AND NOT strong_scam AND NOT genuine AND len(bait_hits) = 0 AND (len(weak_bait_hits) > 0 OR dm_only) AS ask_b FROM {name}1),
{name} AS (SELECT *, CASE WHEN NOT is_hiring THEN 'not_hiring' WHEN strong_scam OR weak_scam >= {L.WEAK_SCAM_SIGNALS} OR ((ask_s OR {yes}) AND s >= {ts}) THEN 'scam_risk' WHEN len(bait_hits) > 0 AND NOT genuine OR ((ask_b OR {yes}) AND b >= {tb}) THEN 'engagement_bait'
  WHEN genuine THEN exposure_label ELSE 'unverified' END AS pred, ask_h::INT + ask_s::INT + ask_b::INT AS calls FROM {name}2)"""


PREDICTED = SCORED + rounds("scored", "p", str(L.HIRING_MIN_SCORE), str(L.BAIT_THRESHOLD), str(L.SCAM_THRESHOLD))
SEVEN = ", ".join(f"({q(x)})" for x in L.LABELS)
LABEL_PRF = PREDICTED + f""", c AS (SELECT label, count(*) FILTER (gold = x.label AND pred = x.label) AS tp, count(*) FILTER (gold = x.label) AS support, count(*) FILTER (pred = x.label) AS predicted FROM (SELECT gold, pred FROM p) g, (VALUES {SEVEN}) AS x(label) GROUP BY x.label),
prf AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf)"""
#: Every row with every threshold: nothing is counted first.
LABEL_SWEEP = SCORED + "grid AS (SELECT CAST(row_number() OVER (ORDER BY x, y, z) - 1 AS INT) AS grid_ord, x AS t_hiring, y AS t_bait, z AS t_scam FROM (SELECT unnest(list_transform(range(19), lambda i: round(0.05 + i * 0.05, 2)::DOUBLE)) AS x), (SELECT unnest(list_transform(range(17), lambda i: round(0.5 + i * 0.03, 2)::DOUBLE)) AS y), (SELECT unnest(list_transform(range(17), lambda i: round(0.5 + i * 0.03, 2)::DOUBLE)) AS z)), slim AS (SELECT gold, h, b, s, left(text, 100) AS text, stage1, strong_scam, weak_scam, genuine, len(bait_hits) > 0 AS baited, len(weak_bait_hits) > 0 AS weakly, dm_only, exposure_label FROM scored), each AS (SELECT slim.*, CASE WHEN baited THEN ['x'] ELSE [] END AS bait_hits, CASE WHEN weakly THEN ['x'] ELSE [] END AS weak_bait_hits, grid_ord, t_hiring, t_bait, t_scam FROM slim, grid),\n" + rounds("each", "p", "t_hiring", "t_bait", "t_scam") + ", m AS (SELECT grid_ord, t_hiring, t_bait, t_scam, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy, (" + " + ".join(f"coalesce(CASE WHEN count(*) FILTER (gold = {q(x)}) > 0 THEN 2.0 * count(*) FILTER (gold = {q(x)} AND pred = {q(x)}) / (count(*) FILTER (gold = {q(x)}) + count(*) FILTER (pred = {q(x)})) END, 0)" for x in L.LABELS) + ") / (" + " + ".join(f"(count(*) FILTER (gold = {q(x)}) > 0)::INT" for x in L.LABELS) + ") AS macro_f1 FROM p GROUP BY ALL)"
AS_OF = SCORED + """dated AS (SELECT *, TIMESTAMP '2026-01-01 12:00:00' + to_days((len(text) % 90)::INT) AS ts FROM scored),
versions AS (SELECT * FROM (VALUES (TIMESTAMP '1970-01-01', true, 0.35::DOUBLE, 0.95::DOUBLE, 0.95::DOUBLE), (TIMESTAMP '2026-01-10', true, 0.5, 0.95, 0.4), (TIMESTAMP '2026-02-01 12:00:00', false, 0.5, 0.6, 0.4), (TIMESTAMP '2026-03-01', true, 0.9, 0.6, 0.4)) AS v(valid_from, hide, t_hiring, t_bait, t_scam)),
set_ AS (SELECT * FROM dated ASOF JOIN versions ON ts >= valid_from),
""" + rounds("set_", "p", "t_hiring", "t_bait", "t_scam", always=True)

PAGE_PARTS = f"SELECT page_id, url, lower(regexp_extract(url, {q(REST)}, 1)) AS host, CASE WHEN regexp_extract(url, {q(REST)}, 2) = '' THEN '/' ELSE regexp_extract(url, {q(REST)}, 2) END AS path FROM pages"

SQL: dict[str, str] = {
    "label_counts": posts("SELECT label, count(*) AS n FROM labelled GROUP BY label"),
    "label_by_source": posts("SELECT source, label, count(*) AS n FROM labelled GROUP BY ALL"),
    "post_labels": posts("SELECT doc_id, label, stage1, genuine, CAST(weak_scam AS INT) AS weak_scam, strong_scam FROM labelled"),
    "phrase_hits": posts("SELECT doc_id, array_to_string(hiring_hits, '|') AS hiring, array_to_string(seeker_hits, '|') AS seeker, array_to_string(not_hiring_hits, '|') AS not_hiring, array_to_string(bait_hits, '|') AS bait, array_to_string(weak_bait_hits, '|') AS weak_bait, array_to_string(scam_hits, '|') AS scam FROM labelled"),
    "phrase_frequency": posts("SELECT phrase, count(*) AS n FROM (SELECT unnest(list_concat(hiring_hits, bait_hits, scam_hits)) AS phrase FROM labelled) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 25"),
    "specificity_scores": posts("SELECT doc_id, role_title, experience, tech_stack, location, salary, CAST(specificity AS INT) AS score FROM labelled"),
    "exposure_labels": posts("SELECT doc_id, exposure_label, round(per_hour, 6) AS per_hour FROM labelled"),
    "url_kinds": posts("SELECT doc_id, array_to_string(list_transform(kinds, lambda u: u.kind), '|') AS kinds, coalesce(array_to_string(list_distinct(list_transform(ats, lambda u: u.name)), '|'), '') AS ats_names, CAST(opaque_links AS INT) AS opaque_links, CAST(shortener_links AS INT) AS shortener_links FROM labelled"),
    "channels": posts("SELECT doc_id, careers_page, google_form, whatsapp, telegram, corporate_email, corporate_matches, free[1] AS free_email_provider, dm_only FROM labelled"),
    "pending_questions": posts(f"SELECT doc_id, CASE WHEN len(text) < {L.MIN_MODEL_TEXT} THEN '' WHEN stage1 = 'ask_model' THEN 'hiring' WHEN stage1 = 'not_hiring' OR strong_scam THEN '' ELSE concat_ws('|', CASE WHEN weak_scam BETWEEN 1 AND {L.WEAK_SCAM_SIGNALS - 1} THEN 'scam' END, CASE WHEN NOT genuine AND len(bait_hits) = 0 AND (len(weak_bait_hits) > 0 OR dm_only) THEN 'bait' END) END AS questions FROM labelled"),
    "not_hiring_reasons": posts(REASONS + "SELECT doc_id, line FROM lines WHERE label = 'not_hiring'"),
    "bait_reasons": posts(REASONS + "SELECT doc_id, line FROM lines WHERE label = 'engagement_bait'"),
    "reason_lines": posts(REASONS + f"SELECT doc_id, {LABELS} AS label, line FROM lines"),
    "company_candidates": posts(COMPANIES + "SELECT doc_id, array_to_string(companies, '|') AS companies, poster_at_company FROM posters"),
    "post_hash": "SELECT doc_id, lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(range(1, len(left(text, 300)) + 1), lambda i: CAST(unicode(text[i]) AS BIGINT))), lambda h, u: (h * 33 + u) % 4294967296), 36)) AS hash FROM documents",
    "careers_links": f"WITH p AS ({PAGE_PARTS}) SELECT page_id, host, path, list_has_any(list_concat(list_slice(string_split(host, '.'), 1, greatest(len(string_split(host, '.')) - 2, 0)), regexp_split_to_array(lower(path), '[/_.]+')), {ls(L.CAREERS_HINTS)}) AS careers FROM p",
    "url_dedupe": f"WITH p AS ({PAGE_PARTS}), k AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') AS key FROM p) SELECT key, min(page_id) AS page_id, count(*) AS n FROM k GROUP BY key",
    "registrable_labels": f"WITH p AS ({PAGE_PARTS}) SELECT DISTINCT host, {label('host')} AS label FROM p",
    "email_domain_classes": f"WITH e AS (SELECT DISTINCT doc_id, lower(split_part(unnest(regexp_extract_all(text, {q('(?i)' + L.EMAIL)})), '@', 2)) AS domain FROM documents) SELECT doc_id, domain, {in_list('domain', L.FREE_EMAIL_DOMAINS)} AS free, {label('domain')} AS label FROM e",
    "url_entries": posts("SELECT key, name, ord FROM (SELECT DISTINCT u.host || u.path AS key, " + entry("u.host", "u.path", [*L.ATS_DOMAINS, *L.FORM_DOMAINS]) + " AS name, " + entry("u.host", "u.path", [(d, p, str(k)) for k, (d, p, _) in enumerate([*L.ATS_DOMAINS, *L.FORM_DOMAINS])]) + "::INT AS ord FROM (SELECT unnest(urls) AS u FROM with_urls)) WHERE name IS NOT NULL"),
    "corporate_emails": f"WITH e AS (SELECT DISTINCT doc_id, lower(split_part(unnest(regexp_extract_all(text, {q('(?i)' + L.EMAIL)})), '@', 2)) AS domain FROM documents) SELECT doc_id, domain FROM e WHERE NOT {in_list('domain', L.FREE_EMAIL_DOMAINS)}",
    "redact_emails": f"SELECT doc_id, sha256({without_emails('text')}) AS digest FROM documents WHERE regexp_matches(text, {q('(?i)' + L.EMAIL)})",
    "redact_documents": f"SELECT doc_id, {without_phones(without_emails('regexp_replace(text, ' + q('(?i)' + L.PROFILE) + ", '[profile]', 'g')"))} AS text FROM documents",
    "flatten_documents": f"SELECT doc_id, sha256({flat('text')}) AS digest FROM documents",
    "text_hash": "SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS id_hash, sha1(text) AS text_sha1, CASE WHEN CAST('0x' || substr(sha1(text), 1, 2) AS INT) % 5 = 0 THEN 'test' ELSE 'dev' END AS split FROM documents",
    "age_parse": "WITH a AS (SELECT event_id, CAST(event_id % 40 AS VARCHAR) || (['s', ' secs', 'm', ' minutes ago', 'h', ' hours', 'd', ' days', 'w', ' wks', 'mo', ' months ago', 'y', ' years', ' x'])[1 + event_id % 15] AS raw, event_id % 40 AS n, event_id % 15 AS u FROM events) SELECT event_id, raw, round(n * ([1/3600, 1/3600, 1/60, 1/60, 1, 1, 24, 24, 168, 168, 720, 720, 8760, 8760, NULL])[1 + u], 6) AS hours FROM a",
    "age_format": "WITH a AS (SELECT event_id, (event_id * 37 % 20000) / 8.0 AS h FROM events) SELECT event_id, CASE WHEN h < 1/60 THEN 'just now' WHEN h < 1 THEN CAST(floor(h * 60 + 0.5) AS BIGINT) || 'm' WHEN h < 24 THEN CAST(floor(h + 0.5) AS BIGINT) || 'h' WHEN h < 168 THEN CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd' WHEN h < 720 THEN CAST(floor(h / 168 + 0.5) AS BIGINT) || 'w' WHEN h < 8760 THEN CAST(floor(h / 720 + 0.5) AS BIGINT) || 'mo' ELSE CAST(floor(h / 8760 + 0.5) AS BIGINT) || 'y' END AS age FROM a",
    "count_parse": "WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN format('{:,}', event_id) WHEN 1 THEN event_id % 100 || '.5K' WHEN 2 THEN event_id % 9 || 'M' ELSE event_id || ' comments' END AS raw FROM events) SELECT event_id, raw, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN (event_id % 100) * 1000 + 500 WHEN 2 THEN (event_id % 9) * 1000000 ELSE event_id END AS BIGINT) AS n FROM a",
    "daily_counts": "SELECT CAST(ts AS DATE) AS date, event_type AS label, count(*) AS n FROM events GROUP BY ALL",
    "seen_once": "SELECT user_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY user_id",
    "dataset_upsert": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "score_cache_misses": "SELECT doc_id, question FROM documents, (VALUES ('hiring'), ('bait'), ('scam')) AS x(question) WHERE doc_id % 3 <> 0 OR question = 'scam'",
    "accuracy": GOLD + " SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM g",
    "per_label_prf": PRF + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "macro_f1": PRF + " SELECT round(avg(f1), 6) AS macro_f1 FROM f WHERE support > 0",
    "confusion_matrix": GOLD + " SELECT gold, count(*) FILTER (pred = 'good') AS good, count(*) FILTER (pred = 'bad') AS bad FROM g GROUP BY gold",
    "threshold_sweep_top8": SWEEP + f" SELECT {SWEEP_COLUMNS} FROM m ORDER BY {SWEEP_ORDER} LIMIT 8",
    "best_per_threshold": SWEEP + f" SELECT {SWEEP_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY t_hiring ORDER BY {SWEEP_ORDER}) AS r FROM m) WHERE r = 1",
    "scored_labels": posts(PREDICTED + " SELECT doc_id, gold, pred, CAST(calls AS INT) AS calls FROM p"),
    "label_accuracy": posts(LABEL_PRF + " SELECT (SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1, (SELECT count(*) FROM p) AS n FROM f WHERE support > 0"),
    "label_report": posts(LABEL_PRF + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f"),
    "label_confusion": posts(PREDICTED + " SELECT gold, " + ", ".join(f"count(*) FILTER (pred = {q(x)}) AS {x}" for x in L.LABELS) + " FROM p GROUP BY gold"),
    "label_mistakes": posts(PREDICTED + " SELECT doc_id, gold, pred, left(text, 110) AS text FROM p WHERE gold <> pred"),
    "label_model_calls": posts(PREDICTED + " SELECT CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (calls > 0) AS posts FROM p"),
    "label_sweep_top8": posts(LABEL_SWEEP + f" SELECT {SWEEP_COLUMNS} FROM m ORDER BY {SWEEP_ORDER} LIMIT 8"),
    "label_sweep_best": posts(LABEL_SWEEP + f" SELECT {SWEEP_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY t_hiring ORDER BY {SWEEP_ORDER}) AS r FROM m) WHERE r = 1"),
    "label_sweep_current": posts(LABEL_SWEEP + f" SELECT {SWEEP_COLUMNS} FROM m WHERE t_hiring = {L.HIRING_MIN_SCORE} AND t_bait = {L.BAIT_THRESHOLD} AND t_scam = {L.SCAM_THRESHOLD}"),
    "labels_as_of": posts(AS_OF + " SELECT doc_id, strftime(ts, '%Y-%m-%d') AS day, t_hiring, t_bait, t_scam, pred AS label, NOT (hide AND pred = 'not_hiring') AS visible FROM p"),
    "tag_frequency": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag ORDER BY n DESC, tag LIMIT 25",
}
