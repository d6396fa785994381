"""The corpus queries that SQL can express, for DuckDB; written from what they return, not from how they get it."""

from __future__ import annotations

from kerbside.llm import quality
from kerbside.llm.secrets import BASE, REACH, WEAK

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = r"""WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
    SELECT *, length(text) + 15 + length(role) + length(regexp_replace(text, '(\\|###|</turn>)', '#', 'g')) - length(regexp_replace(text, '(\\|###|</turn>)', '', 'g'))
        + length(regexp_replace(role, '(\\|###|</turn>)', '#', 'g')) - length(regexp_replace(role, '(\\|###|</turn>)', '', 'g')) AS size FROM rows),
placed AS (
    SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM sized
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

DECONTAMINATE = rf"""WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t
    FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, i, p.n AS n, item_id FROM p JOIN g USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY ALL),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    parts = []
    for kind, pattern, group, least in BASE + WEAK:
        own = _quoted(pattern)
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, i, gaps[i] AS gap, found[i] AS m, length(held[i]) >= {least} AS long
    FROM (SELECT doc_id, regexp_split_to_array(text, {own}) AS gaps, regexp_extract_all(text, {own}) AS found, regexp_extract_all(text, {own}, {group}) AS held
        FROM d WHERE regexp_matches(text, {own})), unnest(range(1, len(found) + 1)) AS r(i)""")
    near = lambda roles: (  # noqa: E731
        "EXISTS (SELECT 1 FROM c y WHERE y.doc_id = x.doc_id AND y.kind IN (" + ", ".join(map(_quoted, roles)) + f") AND greatest(y.s - x.e, x.s - y.e) <= {REACH}"
        " AND NOT (y.s < x.e AND x.s < y.e))"
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
ends AS (SELECT doc_id, kind, long, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
c AS (
    SELECT doc_id, CASE WHEN long THEN kind ELSE 'short_' || kind END AS kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ends
    WHERE long OR kind IN ('assign', 'access')),
kept AS (
    SELECT *, list_position(['assign', 'access', 'hex', 'short_assign', 'short_access', 'login', 'endpoint'], kind) AS k FROM c x WHERE CASE
        WHEN kind IN ('assign', 'access', 'hex') THEN TRUE
        WHEN kind = 'endpoint' THEN {near(["access", "short_access", "login"])} AND {near(["assign", "hex", "short_assign"])}
        WHEN kind IN ('short_access', 'login') THEN {near(["assign", "hex"])} OR ({near(["short_assign"])} AND {near(["endpoint"])})
        ELSE {near(["access"])} OR ({near(["short_access", "login"])} AND {near(["endpoint"])}) END),
lists AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
    FROM kept GROUP BY ALL)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (doc_id)"""


JACCARD = rf"""WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS t
    FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM same JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least_ AS (SELECT node, min(other) AS component_id FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN least_ ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

MERKLE = r"""WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, page_id >> 12 AS archive, page_id & 4095 AS place FROM pages),
r AS (
    SELECT *, 99 + strlen(coalesce(url, '')) + strlen(html) + strlen(CAST(strlen(html) AS VARCHAR)) AS length FROM p),
o AS (
    SELECT *, row_number() OVER w - 1 AS slot, sum(length) OVER w - length AS offset_ FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT page_id AS record_id, url, archive, CAST(slot AS INT) AS slot, CAST(offset_ AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
    CASE WHEN place >= 4090 THEN 'missing' ELSE 'changed' END AS status FROM o WHERE place >= 4090 OR (substr(md5(CAST(page_id AS VARCHAR)), 1, 2) = '03' AND html <> '')"""

SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {SPLIT} AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM d LEFT JOIN marks USING (doc_id)),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS k),
o AS (
    SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM l p, l q, l r, l s, l t
    WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, k AS step, o[k] AS own FROM o, l),
r AS (
    SELECT part, filter_order, step, own, fails[own] AND NOT list_bool_or_before AS here, fails[own] AND list_bool_or_before AS later,
        list_bool_or_before OR fails[own] AS gone, fails[own] AND len(list_filter(fails, lambda x: x)) = 1 AS alone, n, good, toxic
    FROM (SELECT *, len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS list_bool_or_before FROM m, steps)),
g AS (
    SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (later), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (here), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""

_FRAMED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))

MANIFEST = rf"""WITH RECURSIVE rows AS (
    SELECT doc_id, source, sha256({_FRAMED} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256({_FRAMED} || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS altered FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM rows),
low AS (
    SELECT source, 0 AS level, idx, n, leaf AS digest FROM placed
    UNION ALL SELECT source, any_value(level) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY source, idx // 3),
subs AS (SELECT source, level AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, idx, n, digest FROM subs
    UNION ALL SELECT any_value(level) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY idx // 3),
near_ AS (
    SELECT p.source, p.idx, l.level, coalesce(string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx < p.idx // CAST(pow(3, l.level) AS BIGINT)), '') AS before,
        coalesce(string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx > p.idx // CAST(pow(3, l.level) AS BIGINT)), '') AS after
    FROM placed p JOIN low l ON l.source IS NOT DISTINCT FROM p.source AND l.n > 1 AND l.idx // 3 = p.idx // CAST(pow(3, l.level + 1) AS BIGINT) GROUP BY ALL),
far AS (
    SELECT s.source, s.height + h.level AS level, coalesce(string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx < s.idx // CAST(pow(3, h.level) AS BIGINT)), '') AS before,
        coalesce(string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx > s.idx // CAST(pow(3, h.level) AS BIGINT)), '') AS after
    FROM subs s JOIN high h ON h.n > 1 AND h.idx // 3 = s.idx // CAST(pow(3, h.level + 1) AS BIGINT) GROUP BY s.source, s.height, h.level),
steps AS (
    SELECT * FROM near_ UNION ALL SELECT p.source, p.idx, f.level, f.before, f.after FROM placed p JOIN far f ON f.source IS NOT DISTINCT FROM p.source),
proofs AS (SELECT source, idx, list(before ORDER BY level) AS before, list(after ORDER BY level) AS after, string_agg(before || after, '' ORDER BY level) AS joined FROM steps GROUP BY ALL),
whole AS (
    SELECT p.*, coalesce(q.before, []) AS before, coalesce(q.after, []) AS after, coalesce(joined, '') AS joined
    FROM placed p LEFT JOIN proofs q ON q.source IS NOT DISTINCT FROM p.source AND q.idx = p.idx),
fold AS (
    SELECT source, idx, 0 AS level, CASE WHEN crc32_ % 2 = 0 THEN altered ELSE leaf END AS digest, before, after FROM (SELECT *, {{crc}} AS crc32_ FROM whole)
    UNION ALL SELECT source, idx, level + 1, sha256(before[level + 1] || digest || after[level + 1]), before, after FROM fold WHERE level < len(before)),
top_ AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT w.doc_id, w.leaf, s.digest AS subroot, root, sha256(joined) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM whole w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source JOIN fold f ON f.source IS NOT DISTINCT FROM w.source AND f.idx = w.idx AND f.level = len(w.before), top_"""

# CRC-32 of a decimal id: the table of the polynomial, then one step for each character
_CRC_TABLE = []
for _byte in range(256):
    for _ in range(8):
        _byte = _byte >> 1 ^ (0xEDB88320 if _byte & 1 else 0)
    _CRC_TABLE.append(_byte)
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    f"lambda a, c: xor(a >> 8, {_CRC_TABLE}[CAST(xor(a, c) & 255 AS INT) + 1]::BIGINT)), 4294967295)"
)
MANIFEST = MANIFEST.replace("{crc}", _CRC)

_RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": f"n_words > 0 AND 100 * n_symbols > {quality.MOST_SYMBOLS} * n_words",
    "lines": f"n_words > 0 AND 100 * n_dup_lines > {quality.MOST_LINES} * n_words",
    "word_length": f"n_words > 0 AND (word_chars < {quality.SHORT_WORDS} * n_words OR word_chars > {quality.LONG_WORDS} * n_words)",
}


def _quality() -> str:
    sums = ", ".join(f"sum(CAST({r} AS BIGINT)) AS n_{r}" for r in _RULES)
    moments = ", ".join(f"sum(n_{r}) AS k_{r}, sum(n_{r} * n_{r} / n_docs) AS q_{r}" for r in _RULES)
    spreads = ", ".join(f"k_{r} / total AS m_{r}, (q_{r} - k_{r} * k_{r} / total - (hosts - 1) * k_{r} / total * (1 - k_{r} / total)) / (total - squares / total) AS s_{r}" for r in _RULES)
    low, high = quality.LEAST_WEIGHT, quality.MOST_WEIGHT
    weights = ", ".join(
        f"m_{r}, CASE WHEN hosts > 1 AND s_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / s_{r} - 1, {low}), {high}) ELSE {high} END AS w_{r}" for r in _RULES)  # fmt: skip
    rates = ", ".join(f"(n_{r} + m_{r} * w_{r}) / (n_docs + w_{r}) AS rate_{r}" for r in _RULES)
    blamed = " OR ".join(f"({r} AND rate_{r} > {quality.HOST_SOFT})" for r in quality.SOFT)
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, {SPLIT} AS w FROM documents),
windows AS (SELECT id, i, list_slice(w, i, i + 7) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT id, count(DISTINCT j) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-]') GROUP BY id),
found AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN repeated USING (id) LEFT JOIN lines USING (id)),
failed AS (SELECT *, {", ".join(f"{x} AS {r}" for r, x in _RULES.items())} FROM found),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n_docs, {sums} FROM failed GROUP BY source),
one AS (SELECT sum(n_docs) AS total, count(*) AS hosts, sum(n_docs * n_docs) AS squares, {moments} FROM hosts),
spread AS (SELECT hosts, {spreads} FROM one),
prior AS (SELECT {weights} FROM spread),
rates AS (SELECT source, {rates} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
    NOT base AND NOT (rate_base > {quality.HOST_BASE} OR {blamed}) AS kept FROM failed f JOIN rates r ON r.source IS NOT DISTINCT FROM f.source"""


ORACLES = {
    "op1_chat_format": CHAT,
    "op2_decontaminate": DECONTAMINATE,
    "op3_secrets": _secrets(),
    "op5_ngram_jaccard": JACCARD,
    "op6_merkle_audit": MERKLE,
    "op11_filter_audit": AUDIT,
    "op12_dataset_manifest": MANIFEST,
    "op13_host_quality": _quality(),
}
