"""DuckDB SQL of the operators that SQL can express.

Sharding (a heap), the tokenizers, media decoding and the Viterbi labelling are not among them; tests
hold those against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from factloom.llm import licenses, mixing, pii, quality

_WORD = r"[^\x20\x09-\x0D]+"
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters: str) -> str:
    """A bracket class of literal characters."""
    return "".join(f"\\{c}" if c in "\\]^-[" else c for c in characters)


#: The base patterns in plain form, and their tests, for RE2.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+){3}", f"regexp_full_match(value, '{pii.BYTE}(?:[.]{pii.BYTE}){{3}}')"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(digits), k, 1) AS BIGINT)"
        " ELSE CAST(substr(reverse(digits), k, 1) AS BIGINT) * 2 - CASE WHEN CAST(substr(reverse(digits), k, 1) AS BIGINT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
}


def _places(source: str, regex: str, columns: str = "r") -> str:
    """(columns, start, value) of all matches: the pieces between matches give the places."""
    return f"""SELECT {columns}, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, f[i] AS value
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT *, regexp_extract_all(t, '{regex}') AS f, string_split_regex(t, '{regex}') AS p FROM {source}))"""


def pii_sql() -> str:
    kinds = list(_KINDS)
    base = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, start, start + length(value) AS stop, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({_places('d', regex)})) WHERE {test}" for i, (regex, test) in enumerate(_KINDS.values())
    )
    names = [*kinds, "generalised", "removed"]
    shared = "CASE kind WHEN 0 THEN regexp_replace(low, '^.*@', '') WHEN 1 THEN array_to_string(string_split(low, '.')[1:3], '.') WHEN 2 THEN left(digits, 6) ELSE left(digits, 5) END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({base}),
x AS MATERIALIZED (SELECT t, min(r) AS r FROM d WHERE r IN (SELECT r FROM b) GROUP BY t),
y AS (SELECT t, any_value(r) AS r FROM d WHERE r NOT IN (SELECT r FROM b) GROUP BY t),
v AS (SELECT r, kind, lower(value) AS low, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM b WHERE r IN (SELECT r FROM x)),
e AS MATERIALIZED (SELECT DISTINCT r, unnest([({kinds})[kind + 1] || ':' || low, ({kinds})[kind + 1] || ' group:' || {shared}]) AS entity FROM v),
g0 AS (SELECT r, start, stop, coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM b WHERE r IN (SELECT r FROM x)),
g1 AS (SELECT r, since, start AS upto FROM g0 WHERE start >= since UNION ALL SELECT r, max(stop), 1000000000 FROM g0 GROUP BY r),
o AS MATERIALIZED (SELECT DISTINCT r, term FROM (SELECT r, unnest(regexp_extract_all(lower(substr(t, since + 1, upto - since)), '{pii.TERM}')) AS term FROM g1 JOIN x USING (r)) WHERE length(term) >= {pii.LEAST_TERM}),
n AS (SELECT count(DISTINCT t)::DOUBLE AS n FROM d),
nc AS (SELECT entity, count(*)::DOUBLE AS n_c FROM e GROUP BY 1 HAVING count(*) >= {pii.SUPPORT}),
j AS MATERIALIZED (SELECT entity, term, count(*)::DOUBLE AS n_ct FROM e JOIN nc USING (entity) JOIN o USING (r) GROUP BY 1, 2 HAVING count(*) >= {pii.SUPPORT}),
nt AS (SELECT term, count(*)::DOUBLE AS n_t FROM (SELECT term FROM o UNION ALL SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{pii.TERM}'))) FROM y) WHERE term IN (SELECT term FROM j) GROUP BY 1),
risky AS (SELECT entity, term, share >= {pii.REMOVE} AS removed FROM (SELECT entity, term, ln(n_ct * n / (n_c * n_t)) / ln(n / n_c) AS share FROM j JOIN nc USING (entity) JOIN nt USING (term), n WHERE n_c < n) WHERE share >= {pii.GENERALISE}),
risk AS MATERIALIZED (SELECT x.t, term, bool_or(removed) AS removed FROM e JOIN risky USING (entity) JOIN o USING (r, term) JOIN x USING (r) GROUP BY 1, 2),
w AS (SELECT d.r, d.t FROM d WHERE t IN (SELECT t FROM risk)),
s AS (SELECT l.r, CASE WHEN removed THEN 5 ELSE 4 END AS kind, l.start, l.start + length(l.value) AS stop FROM ({_places('w', pii.TERM, 'r, t')}) l JOIN risk ON risk.t = l.t AND risk.term = lower(l.value)
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = l.r AND b.start < l.start + length(l.value) AND l.start < b.stop)),
a AS (SELECT r, kind, start, ({names})[kind + 1] || ':' || start || ':' || stop AS written FROM (SELECT r, kind, start, stop FROM b UNION ALL SELECT * FROM s)),
g AS (SELECT r, {', '.join(f'count(*) FILTER (kind = {i}) AS n_{k}' for i, k in enumerate(kinds))}, string_agg(written, ',' ORDER BY kind, start) FILTER (kind < 4) AS base, string_agg(written, ',' ORDER BY kind, start) AS spans FROM a GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def quality_sql() -> str:
    ends, phrases, marks = _quoted(quality.ENDINGS), _quoted("|".join(quality.BOILERPLATE)), _quoted(quality.ENDINGS + quality.STOPS)
    stop = _quoted(f"[{_class(quality.STOPS)}](?:[\\x20\\x09-\\x0D]|$)")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS words FROM d),
p AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, len(words) AS n FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
m AS (SELECT r, i, n, i <= n - 2 AND count(*) OVER (PARTITION BY r, a, b, c, i <= n - 2) > 1 AS many FROM p),
q AS (SELECT r, many OR coalesce(lag(many) OVER o, false) OR coalesce(lag(many, 2) OVER o, false) AS inside FROM m WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words FROM q GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS place FROM d),
l1 AS MATERIALIZED (SELECT r, place, line, regexp_replace(line, '{_EDGES}', '', 'g') AS body, len(regexp_extract_all(line, '{_WORD}')) AS n, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS solid FROM l0),
x0 AS (SELECT t, min(r) AS r FROM d GROUP BY t),
x1 AS (SELECT r, place, body, n, coalesce(lag(words) OVER o, [])[-{quality.BESIDE}:] AS before, coalesce(lead(words) OVER o, [])[1:{quality.BESIDE}] AS after FROM (SELECT *, regexp_extract_all(body, '{_WORD}') AS words FROM l1) WHERE n > 0 AND r IN (SELECT r FROM x0) WINDOW o AS (PARTITION BY r ORDER BY place)),
x2 AS (SELECT * FROM x1 WHERE n < {quality.SENTENCE_WORDS} QUALIFY row_number() OVER (PARTITION BY r, body ORDER BY place) = 1),
common AS (SELECT body FROM x2 GROUP BY body HAVING count(*) >= {quality.COMMON_TEXTS} AND count(*) >= {quality.COMMON_SHARE}::DOUBLE * (SELECT count(*) FROM d) AND 2 * count(DISTINCT (before, after)) >= count(*)),
l2 AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY place) > 1 AS again, place = max(place) OVER (PARTITION BY r) AS final,
  length(regexp_replace(body, '[^{_class(quality.SEPARATORS)}]', '', 'g')) < {quality.MAX_SEPARATORS}
  AND NOT (n >= {quality.DENSE_WORDS} AND 100 * length(regexp_replace(body, {_quoted('[^' + _class(quality.PUNCTUATION) + ']')}, '', 'g')) > {quality.MAX_PUNCTUATION} * solid)
  AND NOT (n < {quality.SENTENCE_WORDS} AND body IN (SELECT body FROM common))
  AND NOT regexp_matches(translate(body, '{_UPPER}', '{_LOWER}'), {phrases}) AS passes FROM l1 WHERE n > 0),
l3 AS (SELECT *, passes AND NOT again AS sound, place - row_number() OVER (PARTITION BY r, passes AND NOT again ORDER BY place) AS run FROM l2),
par AS (SELECT r, run, strpos({marks}, right(arg_max(body, place), 1)) > 0 OR (bool_or(final) AND bool_or(regexp_matches(body, {stop}))) AS whole FROM l3 WHERE sound GROUP BY r, run),
l4 AS (SELECT l3.r, again, solid, again OR NOT passes OR (n >= {quality.SENTENCE_WORDS} AND strpos({ends}, right(body, 1)) = 0 AND NOT final AND NOT (sound AND (strpos({marks}, right(body, 1)) > 0 OR whole))) AS fails
  FROM l3 LEFT JOIN par ON par.r = l3.r AND par.run = l3.run AND sound),
ln AS (SELECT r, count(*) FILTER (again) AS dup, count(*) FILTER (fails) AS removed, coalesce(sum(solid) FILTER (fails), 0) AS lost FROM l4 GROUP BY r),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^{_class(quality.SYMBOLS)}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_lines, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {quality.MAX_LOST} * word_chars AS kept, n_removed_lines FROM f
"""


def mixing_sql() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    punctuation = _quoted(quality.PUNCTUATION)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
k AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '{_WORD}')) AS BIGINT) AS size,
  0.5::DOUBLE + coalesce(length(translate(t, {punctuation}, ''))::DOUBLE / nullif(length(t), 0), 0.0) * coalesce(len(list_distinct(lines))::DOUBLE / nullif(len(lines), 0), 0.0)
    * least(1.0, coalesce(len(list_distinct(words))::DOUBLE / nullif(3 * sqrt(len(words)), 0), 0.0)) AS weight,
  (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, ([{weights}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS w, {float(mixing.MOST)}::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, {mixing.SHARE}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, coalesce(sum(cap) OVER b, 0.0) AS capped,
  sum(w) OVER () - coalesce(sum(w) OVER b, 0.0) AS open FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (budget - capped) / open AS level FROM s2),
s4 AS (SELECT (SELECT level FROM s3 WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1) AS level),
plan AS (SELECT source, source_size, CASE WHEN s4.level IS NULL THEN cap ELSE least(cap, s4.level * w) END AS target FROM s3, s4),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM plan),
o AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(k.u) / k.weight, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN ahead + size / 2.0 <= rest AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


def near_dedup_sql(words: int = 2, percent: int = 80) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, {shingle} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words} + 2)) AS i FROM d WHERE len(w) >= {words})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {words - 1})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN n na ON na.doc_id = a.doc_id JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= {percent} * greatest(na.n, nb.n) GROUP BY 1, 2),
link AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= {percent} * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
r AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def licenses_sql(dice: float = licenses.DICE) -> str:
    """Dice of bags, from the definition: bigrams are counted on both sides, and the smaller counts add up."""
    low, high = f"{dice / (2 - dice)}::DOUBLE", f"{(2 - dice) / dice}::DOUBLE"
    templates = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    plain = "trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t0(no, license, body) AS (VALUES {templates}),
t1 AS (SELECT no, license, string_split({plain.format('lower(body)')}, ' ') AS w FROM t0),
t2 AS MATERIALIZED (SELECT no, license, len(w) - 1 AS m, unnest({pairs}) AS g FROM t1),
tg AS MATERIALIZED (SELECT no, any_value(license) AS license, any_value(m) AS m, g, count(*) AS c FROM t2 GROUP BY no, g),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS body FROM documents),
l AS MATERIALIZED (SELECT r, body FROM d),
p0 AS MATERIALIZED (SELECT r, unnest(range(len(p))) AS place, unnest(p) AS raw FROM (SELECT r, string_split_regex(body, '\n[ \t\r]*\n') AS p FROM l)),
p1 AS (SELECT r, place, {plain.format('raw')} AS unit FROM p0),
p2 AS (SELECT r, place, unit, string_split(unit, ' ') AS w FROM p1 WHERE contains(unit, ' ')),
p3 AS (SELECT r, place, unit, unnest(list_distinct({pairs})) AS g FROM p2),
p4 AS (SELECT r, place, unit, 2 * count(*) FILTER (g IN (SELECT g FROM tg)) >= count(*) AS licensed FROM p3 GROUP BY ALL),
p5 AS (SELECT r, place, unit, licensed, row_number() OVER (PARTITION BY r ORDER BY place) - row_number() OVER (PARTITION BY r, licensed ORDER BY place) AS run FROM p4),
u AS (SELECT DISTINCT r, unit FROM (
  SELECT r, {plain.format('x')} AS unit FROM (SELECT r, unnest(string_split(body, chr(10))) AS x FROM l UNION ALL SELECT r, unnest(string_split_regex(raw, '[.!?]+[ \t\r\n]+')) FROM p0 UNION ALL SELECT r, raw FROM p0 UNION ALL SELECT r, body FROM l)
  UNION ALL SELECT r, string_agg(unit, ' ' ORDER BY place) FROM p5 WHERE licensed GROUP BY r, run)),
v AS MATERIALIZED (SELECT row_number() OVER () AS v, r, len(w) - 1 AS n, w FROM (SELECT r, string_split(unit, ' ') AS w FROM u) WHERE len(w) > 1),
vg AS (SELECT v, g, count(*) AS c FROM (SELECT v, unnest({pairs}) AS g FROM v) GROUP BY v, g),
m AS (SELECT v, no, any_value(license) AS license, any_value(m) AS m, sum(least(vg.c, tg.c)) AS common FROM vg JOIN tg USING (g) GROUP BY v, no),
b AS (SELECT r, license, max(2.0::DOUBLE * common / (n + m)) AS dice FROM m JOIN v USING (v) WHERE n BETWEEN {low} * m AND {high} * m AND 2.0::DOUBLE * common / (n + m) >= {dice} GROUP BY r, license),
a AS (SELECT r, arg_min(license, (-dice, license)) AS license, round(max(dice), 6) AS dice, string_agg(license, ',' ORDER BY dice DESC, license) AS licenses FROM b GROUP BY r)
SELECT doc_id, license, a.dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN a USING (r)
"""


def lexical_search_sql(k: int = 50) -> str:
    upper = "".join(map(chr, range(65, 91)))
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nt))))) AS BIGINT) AS score FROM t JOIN f USING (term) JOIN q USING (term), c GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


def conversation_repair_sql() -> str:
    """The DP row by row: a cell is eight digits of cost and the edits, so that the least string is the answer."""
    crc = """xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda acc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(acc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""
    more = lambda cell, cost, edit: f"lpad(CAST(CAST(left({cell}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({cell}, 9) || '{edit}'"
    stay = lambda cell, when: f"CASE WHEN NOT gone AND {when} THEN {more(cell, 'cut', 'K')} END"
    role = lambda cell: f"CASE WHEN NOT gone THEN {more(cell, '2 + cut', 'R')} END"
    entered = ", ".join(f"{stay(c, chr(39).join(('r = ', 'u', '')))}, {role(c)}" for c in "nsa")
    least = f"""{more('n', 3, 'D')} AS n, least({more('s', 3, 'D')}, {stay('n', "r = 's'")}) AS s, least({more('u', 3, 'D')}, {entered}) AS u, least({more('a', 3, 'D')}, {stay('u', "r = 'a'")}, {role('u')}) AS a"""
    closed = f"n, s, least(u, {more('n', 2, 'I')}, {more('s', 2, 'I')}, {more('a', 2, 'I')}) AS u, least(a, {more('u', 2, 'I')}) AS a"
    return rf"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c1 AS (SELECT *, {crc} % 20 AS fate FROM c0),
c2 AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM c2),
c4 AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM c3),
w AS MATERIALIZED (SELECT conv_id, turn, i, role, text, left(role, 1) AS r, blank, again AND NOT blank AS dup, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM c4),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM w GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS n, CAST(NULL AS VARCHAR) AS s, '00000002I' AS u, '00000004II' AS a FROM g
  UNION ALL
  SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, {closed} FROM (SELECT dp.conv_id, w.i, {least} FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.i = dp.i + 1)))),
e AS (SELECT g.*, CAST(left(least(n, a), 8) AS BIGINT) AS cost, substr(least(n, a), 9) AS audit FROM g JOIN dp ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.i = g.rows),
p AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM e),
q AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS k FROM p),
z AS (SELECT q.*, w.role, w.text, bool_or(k = 1 AND edit = 'K' AND w.r = 's') OVER (PARTITION BY q.conv_id) AS led FROM q LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM q.conv_id AND w.i = q.i),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (k + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM z WHERE edit <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""


def url_filters_sql() -> str:
    from factloom.llm.url_filters import RULES

    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    upper = "".join(map(chr, range(65, 91)))
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}')"
    path = lambda u: f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
    beside = f"regexp_extract({path('url')}, '(?s)^(.*/)', 1)"
    site = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"
    return rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {rules}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
named AS (SELECT url, CASE WHEN lower(left(tag, 5)) = '<link' THEN CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|''[^'']*\bcanonical\b[^'']*''|canonical\b)')
    THEN concat(regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1), regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2), regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)) END
  WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^''">]*)', 1) END AS target FROM tags),
trimmed AS (SELECT url, replace(trim(target), '&amp;', '&') AS t FROM named WHERE target IS NOT NULL),
links AS (SELECT url, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
  WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '/') THEN {site} || t ELSE {site} || CASE WHEN {beside} = '' THEN '/' ELSE {beside} END || t END AS target FROM trimmed),
e AS MATERIALIZED (SELECT DISTINCT {node('url')} AS a, {node('target')} AS b FROM links),
both_ways AS MATERIALIZED (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
comp AS (SELECT a AS node, least(min(b), a) AS component FROM reach GROUP BY a),
ruled AS (SELECT node, component, (SELECT max_by(v, (length(h || p), v = 'allow')) FROM rules WHERE ({host("'://' || node")} = h OR ends_with({host("'://' || node")}, '.' || h)) AND starts_with({path("'://' || node")}, p)) AS v FROM comp),
spread AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM ruled GROUP BY component),
u AS (SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path, {node('url')} AS node FROM pages),
r AS (SELECT u.*, (SELECT max_by((h || p, v), (length(h || p), v = 'allow')) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM u)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], spread.v, 'allow') AS verdict, component FROM r LEFT JOIN comp USING (node) LEFT JOIN spread USING (component)"""


ORACLES: dict[str, str] = {
    "op1_pii": pii_sql(),
    "op5_licenses": licenses_sql(),
    "op7_near_dedup": near_dedup_sql(),
    "op9_quality": quality_sql(),
    "op10_mixing": mixing_sql(),
    "op11_lexical_search": lexical_search_sql(),
    "op12_conversation_repair": conversation_repair_sql(),
    "op13_url_filters": url_filters_sql(),
}
