"""SQL of those operators that SQL can express, for an engine that runs the same tables."""

from __future__ import annotations

from .neardup import LEAST, WORDS
from .sharding import BUCKET_ROWS
from .urls import BASE, DEFAULT_RULES, ORDER


def _score(shard: int) -> str:
    return f"-1.0 / ln((('0x' || substr(md5('shard:{shard}:' || name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def _winner(shards: int) -> str:
    """The first place of the largest score."""
    scores = f"[{', '.join(_score(i) for i in range(shards))}]"
    return f"list_position({scores}, list_max({scores})) - 1"


SHARDING = f"""WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
base AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS name, strlen(coalesce(text, '')) + 1 AS size,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crcs),
dealt AS (SELECT *, {_winner(8)} AS shard, {_winner(9)} AS grown_shard, ('0x' || substr(md5(name || ':' || size || ':' || text_crc32), 1, 8))::BIGINT % (SELECT greatest(1, -(-count(*) // {BUCKET_ROWS})) FROM documents) AS bucket FROM base)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM dealt"""


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"


def _by_rule(value) -> str:
    return "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{value(r, v)}'" for r, v in sorted(DEFAULT_RULES, key=lambda x: len(x[0]))[::-1]) + " END"


def _level(k: int) -> str:
    """Probabilities of the k-symbol codes, from the shorter ones by Witten-Bell interpolation."""
    size = BASE ** (k - 1)
    return f"""c{k} AS (SELECT ok, code % {BASE**k} AS g, count(*) AS c FROM grams GROUP BY ALL),
x{k} AS (SELECT ok, g // {BASE} AS x, sum(c) AS s, count(*) AS t FROM c{k} GROUP BY ALL),
p{k} AS (SELECT q.ok, i AS g, CASE WHEN s > 0 THEN (coalesce(c, 0) + t * p) / (s + t) ELSE p END AS p FROM range({BASE**k}) r(i) JOIN p{k - 1} q ON q.g = i % {size} LEFT JOIN x{k} ON x{k}.ok = q.ok AND x = i // {BASE} LEFT JOIN c{k} ON c{k}.ok = q.ok AND c{k}.g = i)"""


SYMBOLS = "translate(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z0-9+.-]*://', ''), '[0-9]', '0', 'g'), '[^a-z0./=-]', '~', 'g'), '0./=-~', 'ABCDEF')"
URLS = f"""WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parted AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosted),
ruled AS (SELECT *, {_by_rule(lambda r, v: r)} AS rule, {_by_rule(lambda r, v: v)} AS by_rule, ('0x' || substr(md5(url), 1, 8))::BIGINT % 10 = 0 AS held_out,
 list_transform(string_split('FF' || {SYMBOLS}, ''), lambda c: CASE WHEN ascii(c) >= 97 THEN ascii(c) - 97 ELSE ascii(c) - 39 END) AS sym FROM parted),
coded AS (SELECT * EXCLUDE (sym), row_number() OVER () AS rid, list_transform(range(1, len(sym) - 1), lambda i: (sym[i] * {BASE} + sym[i + 1]) * {BASE} + sym[i + 2]) AS codes FROM ruled),
grams AS (SELECT by_rule = 'allow' AS ok, unnest(codes) AS code FROM coded WHERE by_rule IS NOT NULL AND NOT held_out),
p0 AS (SELECT ok, 0 AS g, 1.0::DOUBLE / {BASE} AS p FROM (VALUES (true), (false)) t(ok)),
{", ".join(_level(k) for k in range(1, ORDER + 1))},
ratios AS (SELECT g, CASE WHEN (SELECT count(DISTINCT ok) FROM grams) = 2 THEN (ln(max(p) FILTER (ok)) - ln(max(p) FILTER (NOT ok)))::FLOAT ELSE 0 END AS ratio FROM p{ORDER} GROUP BY g),
sums AS (SELECT rid, sum(ratio::DOUBLE) AS total FROM (SELECT rid, unnest(codes) AS g FROM coded) JOIN ratios USING (g) GROUP BY rid),
scored AS (SELECT coded.*, round(coalesce(total, 0) / greatest(len(codes), 1), 6) AS score FROM coded LEFT JOIN sums USING (rid)),
m AS (SELECT avg(score) FILTER (by_rule = 'allow') AS m1, avg(score) FILTER (by_rule = 'block') AS m0, stddev_pop(score) FILTER (by_rule = 'allow') AS d1, stddev_pop(score) FILTER (by_rule = 'block') AS d0 FROM scored WHERE held_out),
t AS (SELECT coalesce(round(CASE WHEN d0 + d1 > 0 THEN (m1 * d0 + m0 * d1) / (d0 + d1) ELSE (m0 + m1) / 2 END, 6), 0) AS threshold FROM m)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score FROM scored, t"""

# every pair that shares a shingle, and the classes that their links connect
NEAR = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS run FROM words),
bag AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM bag GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS same FROM bag a JOIN bag b USING (run) WHERE a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE same / (x.n + y.n - same) >= {LEAST}::DOUBLE),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, CASE WHEN a = other THEN b ELSE a END FROM reach JOIN linked ON a = other OR b = other),
classed AS (SELECT id AS doc_id, min(other) AS class_id FROM reach GROUP BY id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS stays FROM classed"""

SQL = {"op5_url_filter": URLS, "op6_bagminhash": NEAR, "op8_rendezvous_sharding": SHARDING}
