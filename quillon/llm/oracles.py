"""The SQL of those corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from quillon.llm import mixing, quality, resample, sharding

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def op3() -> str:
    """The measures by lists and joins, expectation-maximisation by a recursive table of parameters."""
    n, total = len(quality.RULES), f"(SELECT sum(n) FROM pats) * {quality.PRIOR_WEIGHT!r}::DOUBLE"
    pg, bad, good = quality.PRIOR_GOOD_SHARE, quality.PRIOR_BAD, quality.PRIOR_GOOD
    first = [f"ln({pg / (1 - pg)!r}::DOUBLE)"] + [f"ln({g / b!r}::DOUBLE)" for _ in range(n) for b, g in zip(bad, good)]
    odds = " + ".join(["params[1]"] + [f"params[{2 + 3 * j} + v[{j + 1}]]" for j in range(n)])
    sums = ", ".join(f"sum(CASE WHEN v[{j + 1}] = {k} THEN n * p ELSE 0 END) AS g{j}_{k}, sum(CASE WHEN v[{j + 1}] = {k} THEN n * (1 - p) ELSE 0 END) AS b{j}_{k}" for j in range(n) for k in range(3))
    new = [f"ln((g + w * {pg!r}::DOUBLE) / (b + w * {1 - pg!r}::DOUBLE))"] + [f"ln(((g{j}_{k} + w * {good[k]!r}::DOUBLE) / (g + w)) / ((b{j}_{k} + w * {bad[k]!r}::DOUBLE) / (b + w)))" for j in range(n) for k in range(3)]
    rules = [
        ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
        ("25 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
        ("2 * n_capitals > word_chars", "4 * n_capitals <= word_chars"),
        ("5 * n_exclaims > n_words", "20 * n_exclaims <= n_words"),
        ("2 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
        ("10 * n_repeat_words > 4 * n_words", "10 * n_repeat_words <= n_words"),
        ("word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_words = 0", "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
        ("10 * n_line_ends < n_lines", "2 * n_line_ends >= n_lines"),
    ]
    votes = ", ".join(f"CASE WHEN {b} THEN 0 WHEN {g} THEN 2 ELSE 1 END" for b, g in rules)
    code = " + ".join(f"v[{j + 1}] * {3 ** (n - 1 - j)}" for j in range(n))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 3),
keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM places),
covered AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM keyed WHERE k > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{WS}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(c, 0) AS n_repeat_words, len(l) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_exclaims,
  len(regexp_extract_all(text, '[.!?;:]["'')]*(\n|$)')) AS n_line_ends FROM d LEFT JOIN covered USING (doc_id)),
x AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, [{votes}] AS v FROM m),
pats AS (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY v),
em AS (
  SELECT 0 AS it, [{", ".join(first)}] AS params
  UNION ALL
  SELECT it + 1, [{", ".join(new)}] FROM (
    SELECT it, {total} AS w, sum(n * p) AS g, sum(n * (1 - p)) AS b, {sums} FROM (SELECT it, n, v, 1 / (1 + exp(-({odds}))) AS p FROM em, pats WHERE it < {quality.ROUNDS}) GROUP BY it)),
post AS (SELECT v, 1 / (1 + exp(-({odds}))) AS p FROM em, pats WHERE it = {quality.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, {_r6("p")} AS p_good, CAST({code} AS INTEGER) AS pattern
FROM x JOIN post USING (v)"""


def op4() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT reach.doc_id, steps.b FROM reach JOIN steps ON steps.a = reach.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM (SELECT doc_id, min(node) AS c FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""


def op6() -> str:
    return """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM q"""


def op7() -> str:
    """Water filling in closed form: children sorted by capacity over weight are full up to the first that is not."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    levels, parts, last = list(mixing.LEVELS), [], "root"
    for k, level in enumerate(levels):
        path, above = ", ".join(levels[: k + 1]), ", ".join(levels[:k]) or "1"
        join = f"JOIN {last} USING ({', '.join(levels[:k])})" if k else "CROSS JOIN root"
        parts.append(f"""
c{k} AS (SELECT {path}, sum(cap) AS cap, {weight(level)} AS w FROM leaf GROUP BY {path}),
o{k} AS (SELECT c{k}.*, given, given - coalesce(sum(cap) OVER (PARTITION BY {above} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
  sum(w) OVER (PARTITION BY {above} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM c{k} {join}),
f{k} AS (SELECT *, cap * w_left <= left_ * w AS is_full FROM o{k}),
r{k} AS (SELECT *, min(CASE WHEN NOT is_full THEN {{'x': cap / w, 'y': {level}, 'l': left_, 'w': w_left}} END) OVER (PARTITION BY {above}) AS rest FROM f{k}),
g{k} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE (rest.l * w) // rest.w END AS given FROM r{k})""")
        last = f"g{k}"
    names = ", ".join(levels)
    return rf"""
WITH q AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS k, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents),
t AS (SELECT doc_id, CASE WHEN k = '' THEN '?' WHEN CAST(k AS INTEGER) < 10 THEN 'web' WHEN CAST(k AS INTEGER) < 15 THEN 'books' ELSE 'reference' END AS domain, lang, source, n_tokens FROM q),
leaf AS (SELECT {names}, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * {mixing.MAX_EPOCHS} AS BIGINT) AS cap FROM t GROUP BY {names} HAVING sum(n_tokens) > 0),
root AS (SELECT CAST(least((sum(supply) * {mixing.BUDGET_PERCENT}) // 100, sum(cap)) AS BIGINT) AS given FROM leaf),
{",".join(parts)},
b AS (SELECT {names}, supply, given AS tokens FROM leaf JOIN {last} USING ({names}) WHERE given > 0),
e AS (SELECT doc_id, {names}, n_tokens, supply, tokens, CAST(unnest(range(0, CAST((tokens - 1) // supply + 1 AS BIGINT))) AS INTEGER) AS epoch FROM t JOIN b USING ({names})),
h AS (SELECT *, md5('{mixing.SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '?')) AS key FROM e),
s AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY {names}, epoch ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h)
SELECT doc_id, {names}, epoch, start, n_tokens, CAST(least(n_tokens, tokens - epoch * supply - start) AS BIGINT) AS take FROM s WHERE least(n_tokens, tokens - epoch * supply - start) > 0"""


def op9(n_shards: int = 24) -> str:
    """CRC-32 by its table over the bytes, slots dealt one after the other by a recursive table."""
    return rf"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM d, crc),
v AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '?') || '|' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.N_SLOTS} AS INTEGER) AS virtual_slot FROM c),
load AS (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM v GROUP BY 1),
seq AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k FROM load),
deal AS (
  SELECT 0::BIGINT AS k, -1 AS virtual_slot, -1 AS shard, list_transform(range(0, {n_shards}), lambda i: 0::BIGINT) AS loads
  UNION ALL
  SELECT k, vs, spot - 1, list_transform(loads, lambda x, i: x + CASE WHEN i = spot THEN bytes ELSE 0 END) FROM (SELECT s.k, s.virtual_slot AS vs, s.bytes, loads, CAST(list_position(loads, list_min(loads)) AS INTEGER) AS spot FROM deal JOIN seq s ON s.k = deal.k + 1))
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot FROM v JOIN (SELECT virtual_slot, shard FROM deal WHERE k > 0) USING (virtual_slot)"""


def _crc32(ids: str, value: str) -> str:
    """WITH parts crc_bits, crc_tab and crc (value, crc) of the distinct texts of the table ids."""
    return rf"""
crc_bits AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_tab AS (SELECT list(c ORDER BY i) AS tab FROM crc_bits WHERE k = 8),
crc AS (SELECT {value}, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT {value} FROM {ids}), crc_tab)"""


def op11() -> str:
    n = resample.N_BUCKETS
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS g FROM d),
b AS (SELECT unnest({words}) AS g FROM benchmark),
every AS (SELECT g FROM f UNION SELECT g FROM b),{_crc32("every", "g")},
s AS (SELECT crc % {n} AS bucket, count(*) AS s FROM f JOIN crc USING (g) GROUP BY 1),
t AS (SELECT crc % {n} AS bucket, count(*) AS t FROM b JOIN crc USING (g) GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM b) AS t_all),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {n}) / ((s + 1)::DOUBLE * (t_all + {n})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sizes),
won AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN crc USING (g) JOIN gain ON gain.bucket = crc.crc % {n} GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN won USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT *, CASE WHEN n_features >= {resample.LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {resample.LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * {resample.PERCENT} // 100 FROM y WHERE n_features >= {resample.LEAST_WORDS}) THEN place END AS rank FROM r"""


def op12() -> str:
    """Pairs of equal words at each lag, islands of neighbouring ones; of stretches alike the smallest lag is the period."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),{_crc32("d", "id")},
g AS (SELECT doc_id, w, len(w) AS n, crc AS h, crc // 10 AS g FROM d JOIN crc USING (id)),
a AS (SELECT doc_id, w, n, h, g, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT doc_id, w, n, h, a, 1 + (n - a) // (3 + g % 8) AS p FROM a),
v AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + i % p + 1])) ELSE w END AS w FROM p),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM v),
same AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i),
isles AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle, i FROM same),
stretches AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM isles GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min(runs, (-length, start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
