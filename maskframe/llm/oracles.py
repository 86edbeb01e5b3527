"""SQL twins of the corpus queries that SQL can state, for DuckDB."""

from __future__ import annotations

import re

from .op1_language_id import HASHES, LEAST_SHARE, SAMPLE_DOCS, SLOTS_PER_GRAM
from .op10_simhash import RADIUS, SEED, SHINGLE
from .op5_secret_scans import KINDS, RULE_SETS
from .op9_host_rules import BASE_RULES, HOST_LEAST, HOST_TIMES, HOST_Z, RULES, SOFT_RULES

WARC = """
WITH q AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q LEFT JOIN f USING (digest)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, k, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _rule_sql(kind: str, pattern: str, group: int, least: int, span: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {KINDS.index(kind)} AS rank, '{kind}' AS kind,
       CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w - length(p) AS BIGINT) AS a, CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w AS BIGINT) AS b, length(g) >= {least} AS long
FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, unnest(s[1 : len(m)]) AS gap, unnest(m) AS m, unnest(g) AS g, unnest(p) AS p
      FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS s, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, regexp_extract_all(text, '{pattern}', {span}) AS p FROM documents WHERE regexp_matches(text, '{pattern}')))
WINDOW w AS (PARTITION BY doc_id ORDER BY k)
"""


def _secrets() -> str:
    rules = [(k, p, g, n, span) for rules in RULE_SETS.values() for k, p, g, n, _, span in rules]
    every = " UNION ALL ".join(f"({_rule_sql(*r)})" for r in rules)
    count = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:3])
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS[:3])
    joined = "string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank)"
    return f"""
WITH f AS (SELECT * FROM ({every}) WHERE long),
n AS (SELECT doc_id, {sums}, {joined} AS spans, {joined} FILTER (rank < 3) AS base FROM f GROUP BY doc_id)
SELECT d.doc_id, {count}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN n USING (doc_id)
"""


SECRETS = _secrets()



def _host_rules() -> str:
    sql = {r: re.sub(r"(\d)D\b", r"\1::DOUBLE", c) for r, c in RULES.items()}
    flags = ", ".join(f"{c} AS fails_{r}" for r, c in sql.items())
    counts = ", ".join(f"sum(fails_{r}::INTEGER)::DOUBLE AS k_{r}" for r in RULES)
    moments = ", ".join(f"sum(k_{r}) AS k_{r}, sum(k_{r} * k_{r} / n) AS q_{r}, (sum(k_{r}) + 0.5) / (sum(n) + 1) AS m_{r}" for r in RULES)
    size = "least(greatest(m_{0} * (1 - m_{0}) / greatest(greatest(q_{0} / n - (k_{0} / n) * (k_{0} / n), 0) - m_{0} * (1 - m_{0}) * hosts / n, 0.0001 * m_{0} * (1 - m_{0})) - 1, 2), 10000) AS s_{0}, greatest({1}::DOUBLE, {2} * k_{0} / n) AS top_{0}, m_{0}"
    sizes = ", ".join(size.format(r, HOST_LEAST, HOST_TIMES) for r in RULES)
    shrunk = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) AS r_{r}, n + s_{r} AS t_{r}, top_{r}" for r in RULES)
    bad = ", ".join(f"r_{r} - {HOST_Z} * sqrt(r_{r} * (1 - r_{r}) / (t_{r} + 1)) > top_{r} AS bad_{r}" for r in RULES)
    base = " OR ".join(f"fails_{r}" for r in BASE_RULES)
    strict = " OR ".join(f"coalesce(bad_{r}, false)" for r in BASE_RULES)
    soft = " OR ".join(f"(fails_{r} AND (coalesce(bad_{r}, false) OR {strict}))" for r in SOFT_RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
lines AS (SELECT doc_id, sum(n - 1) AS dup FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
grams AS (SELECT doc_id, k, w[k : k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY doc_id),
s AS (SELECT d.doc_id, CASE WHEN source IS NOT NULL THEN lower(regexp_extract(source, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)', 1)) END AS host, CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
u AS (SELECT *, {flags} FROM s),
h AS (SELECT host, count(*)::DOUBLE AS n, {counts} FROM u WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(n) AS n, count(*) AS hosts, {moments} FROM h),
p AS (SELECT {sizes} FROM m),
v AS (SELECT host, {shrunk} FROM h, p),
b AS (SELECT host, {bad} FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT ({base}) AND NOT ({soft}) AS kept
FROM u LEFT JOIN b USING (host)
"""


HOST_RULES = _host_rules()

# Bytes as pairs of hexadecimal digits: a window at each byte, those whose hash occurs twice, their union, and what is left.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, k, hash(substr(h, 2 * k + 1, 400)) AS a FROM (SELECT doc_id, h, unnest(range(n - 199)) AS k FROM d WHERE n >= 200)),
twice AS (SELECT a FROM w GROUP BY a HAVING count(*) > 1),
marks AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM w JOIN twice USING (a)),
runs AS (SELECT doc_id, run, min(k) AS start, max(k) + 200 AS stop FROM (SELECT doc_id, k, count(*) FILTER (before IS NULL OR k > before + 200) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marks) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS kept FROM runs),
found AS (SELECT doc_id, sum(stop - start) AS removed, count(*) AS spans, max(stop) AS last, string_agg(substr(h, 2 * kept + 1, 2 * (start - kept)), '' ORDER BY start) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id)
"""

# The primes and shifts of XXH64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


ZERO = "0::UBIGINT"


def _times(x: str, k: int) -> str:
    """x * k modulo 2^64."""
    return f"CAST((CAST({x} AS UHUGEINT) * {k}::UHUGEINT) % {1 << 64}::UHUGEINT AS UBIGINT)"


def _plus(x: str, y: str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) + CAST({y} AS UHUGEINT)) % {1 << 64}::UHUGEINT AS UBIGINT)"


def _turn(x: str, r: int) -> str:
    """x rotated by r bits."""
    return f"CAST((CAST({x} AS UHUGEINT) * {1 << r}::UHUGEINT) % {1 << 64}::UHUGEINT + ({x} >> {64 - r}) AS UBIGINT)"


def _round(acc: str, x: str) -> str:
    return _times(_turn(_plus(acc, _times(x, _P[1])), 31), _P[0])


def _scrambled(query: str, column: str, shifts: tuple[int, int, int], primes: tuple[int, int]) -> str:
    """The query with a column of 64 bits sent through shifts and multiplications in turn."""
    for shift, prime in zip(shifts, primes):
        query = f"SELECT * REPLACE ({_times(f'xor({column}, {column} >> {shift})', prime)} AS {column}) FROM ({query})"
    return f"SELECT * REPLACE (xor({column}, {column} >> {shifts[2]}) AS {column}) FROM ({query})"


def _xxh64(source: str, text: str, seed: int) -> str:
    """The columns of a query and `h`, the XXH64 of its column `text` in UTF-8, a published step at a time."""
    m = 1 << 64
    times, plus, turn, step = _times, _plus, _turn, _round
    number = lambda at, n: "CAST(concat('0x', " + ", ".join(f"substr(hx, CAST({at} + {2 * i} AS BIGINT), 2)" for i in reversed(range(n))) + ") AS UBIGINT)"
    query = f"SELECT *, hex(encode({text})) AS hx, CAST(strlen({text}) AS BIGINT) AS size FROM ({source})"
    # Eight bytes at a time, and behind the last 32 those that are left; then four, then one.
    words = f"list_transform(range(0, size // 8), lambda i: {number('16 * i + 1', 8)})"
    query = f"SELECT *, {words} AS w, size // 32 * 4 AS wide FROM ({query})"
    starts = [(seed + _P[0] + _P[1]) % m, (seed + _P[1]) % m, seed, (seed - _P[0]) % m]
    lanes = ", ".join(f"list_reduce(list_prepend({start}::UBIGINT, list_transform(range({i}, wide, 4), lambda i: w[i + 1])), lambda a, b: {step('a', 'b')}) AS v{i}" for i, start in enumerate(starts))
    query = f"SELECT *, {lanes} FROM ({query})"
    query = f"SELECT *, {plus(plus(turn('v0', 1), turn('v1', 7)), plus(turn('v2', 12), turn('v3', 18)))} AS h FROM ({query})"
    for i in range(4):
        query = f"SELECT * REPLACE ({plus(times(f'xor(h, {step(ZERO, f'v{i}')})', _P[0]), _P[3])} AS h) FROM ({query})"
    query = f"SELECT * REPLACE ({plus(f'CASE WHEN size >= 32 THEN h ELSE {(seed + _P[4]) % m}::UBIGINT END', 'size')} AS h) FROM ({query})"
    folds = [
        ("w[wide + 1 :]", lambda a, b: plus(times(turn(f"xor({a}, {step(ZERO, b)})", 27), _P[0]), _P[3])),
        (f"CASE WHEN size % 8 >= 4 THEN [{number('16 * (size // 8) + 1', 4)}] ELSE [] END", lambda a, b: plus(times(turn(f"xor({a}, {times(b, _P[0])})", 23), _P[1]), _P[2])),
        (f"list_transform(range(size - size % 4, size), lambda i: {number('2 * i + 1', 1)})", lambda a, b: times(turn(f"xor({a}, {times(b, _P[4])})", 11), _P[0])),
    ]
    for part, fold in folds:
        query = f"SELECT * REPLACE (list_reduce(list_prepend(h, CAST({part} AS UBIGINT[])), lambda a, b: {fold('a', 'b')}) AS h) FROM ({query})"
    return f"SELECT * EXCLUDE (hx, size, w, wide, v0, v1, v2, v3) FROM ({_scrambled(query, 'h', (33, 29, 32), (_P[1], _P[2]))})"


def _simhash() -> str:
    shingles = f"SELECT doc_id, array_to_string(w[k : k + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS ({shingles}),
hashed AS ({_xxh64("SELECT DISTINCT g FROM s", "g", SEED)}),
votes AS (SELECT doc_id, b, 2 * sum(CAST((h >> b) & 1 AS INTEGER)) > count(*) AS one FROM s JOIN hashed USING (g), (SELECT unnest(range(64)) AS b) GROUP BY doc_id, b),
found AS (SELECT doc_id, CAST(sum(CASE WHEN one THEN CAST(1 AS HUGEINT) << CAST(b AS INTEGER) ELSE 0 END) AS UBIGINT) AS fp FROM votes GROUP BY doc_id),
fps AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN found USING (doc_id)),
nodes AS (SELECT fp, min(doc_id) AS least FROM fps GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a, nodes b WHERE bit_count(xor(a.fp, b.fp)) <= {RADIUS} AND a.fp <> b.fp),
reach AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN nodes ON b = fp GROUP BY a)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM fps JOIN classes USING (fp)
"""


SIMHASH = _simhash()


def _language_id() -> str:
    upper, lower = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])), "".join(map(chr, [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
    long = f"SELECT doc_id, {_plus(_times(_turn(f'xor({(42 + _P[4] + 8) % (1 << 64)}::UBIGINT, {_round(ZERO, chr(117))})', 27), _P[0]), _P[3])} AS h FROM (SELECT doc_id, CAST(doc_id AS UBIGINT) AS u FROM labelled)"
    hashed = _scrambled(long, "h", (33, 29, 32), (_P[1], _P[2]))
    mixed = _scrambled("SELECT g, CAST(concat('0x', g[7:8], g[5:6], g[3:4], g[1:2]) AS UBIGINT) AS h FROM every", "h", (33, 33, 33), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
    return rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, text, lang, coalesce(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS UBIGINT))), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) % 5 = 0, false) AS held_out FROM documents, t),
labelled AS (SELECT * FROM d WHERE lang IS NOT NULL AND NOT held_out AND doc_id IS NOT NULL),
sizes AS (SELECT lang, count(*) AS size FROM labelled GROUP BY lang),
hashed AS ({hashed}),
sample AS (SELECT DISTINCT doc_id FROM labelled JOIN sizes USING (lang) JOIN hashed USING (doc_id) WHERE ((CAST(h AS HUGEINT) - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END) % 1000000 + 1000000) % 1000000 < least(1.0::DOUBLE, {SAMPLE_DOCS}::DOUBLE / size) * 1000000),
plain AS (SELECT doc_id, hex(encode(concat(' ', regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x60\x7B-\x7F]', ' ', 'g'), ' '))) AS hx FROM d),
grams AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, substr(hx, 2 * k + 1, 8) AS g FROM (SELECT doc_id, hx, unnest(range(length(hx) // 2 - 3)) AS k FROM plain)) WHERE g[3:4] <> '20' AND g[5:6] <> '20' GROUP BY doc_id, g),
counts AS (SELECT lang, g, sum(n) AS n FROM grams JOIN sample USING (doc_id) JOIN labelled USING (doc_id) GROUP BY lang, g),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
kept AS (SELECT lang, g, n, total FROM counts JOIN totals USING (lang) WHERE n >= greatest(2::DOUBLE, total * {LEAST_SHARE}::DOUBLE)),
width AS (SELECT greatest(10, length(bin(greatest(count(DISTINCT g), 1) * {SLOTS_PER_GRAM} - 1))) AS bits FROM kept),
every AS (SELECT DISTINCT g FROM grams),
places AS (SELECT g, k, CAST((CAST(h AS UHUGEINT) + k::UHUGEINT * CAST((h >> 32) | 1 AS UHUGEINT)) % CAST(CAST(1 AS BIGINT) << CAST(bits AS BIGINT) AS UHUGEINT) AS BIGINT) AS slot FROM ({mixed}), (SELECT unnest(range({HASHES})) AS k), width),
filled AS (SELECT DISTINCT lang, slot FROM kept JOIN places USING (g)),
rates AS (SELECT lang, fill * fill * fill AS f, greatest(coalesce(own, 0), 0.001::DOUBLE) AS own FROM (SELECT lang, CAST(coalesce(filled, 0) AS DOUBLE) / (CAST(1 AS BIGINT) << CAST(bits AS BIGINT)) AS fill, own FROM sizes LEFT JOIN (SELECT lang, count(*) AS filled FROM filled GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, CAST(sum(n) AS DOUBLE) / CAST(any_value(total) AS DOUBLE) AS own FROM kept GROUP BY lang) USING (lang), width)),
holds AS (SELECT g, lang FROM places JOIN filled USING (slot) GROUP BY g, lang HAVING count(*) = {HASHES}),
hits AS (SELECT doc_id, lang, sum(n) AS hits FROM grams JOIN holds USING (g) GROUP BY doc_id, lang),
found AS (SELECT doc_id, sum(n) AS total FROM grams GROUP BY doc_id),
value AS (SELECT doc_id, lang, greatest((CAST(coalesce(hits, 0) AS DOUBLE) - CAST(coalesce(total, 0) AS DOUBLE) * f) / (1 - f), 0) / own AS v FROM (SELECT doc_id FROM d) CROSS JOIN rates LEFT JOIN found USING (doc_id) LEFT JOIN hits USING (doc_id, lang)),
best AS (SELECT doc_id, v[1] AS first, coalesce(v[2], 0) AS second, names[1] AS name FROM (SELECT doc_id, list(v ORDER BY v DESC, lang) AS v, list(lang ORDER BY v DESC, lang) AS names FROM value GROUP BY doc_id))
SELECT d.doc_id, held_out,
       CASE WHEN name IS NULL OR NOT coalesce(regexp_matches(text, '\p{{L}}'), false) THEN 'und' WHEN first > 0 THEN name ELSE (SELECT lang FROM sizes ORDER BY size DESC, lang LIMIT 1) END AS lang_pred,
       CASE WHEN first > 0 AND regexp_matches(text, '\p{{L}}') THEN first / greatest(first + second, 1e-12) ELSE 0 END AS score
FROM d LEFT JOIN best USING (doc_id)
"""


LANGUAGE_ID = _language_id()

SQL = {"op1_language_id": LANGUAGE_ID, "op3_warc": WARC, "op4_decontamination": DECONTAMINATION, "op5_secret_scans": SECRETS, "op6_suffix_dedup": REPEATS, "op9_host_rules": HOST_RULES, "op10_simhash": SIMHASH}
