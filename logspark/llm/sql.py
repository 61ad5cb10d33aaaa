"""DuckDB SQL for the corpus queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows of 50 words; repeated ones are those that a document with a smaller doc_id has too.
SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
first AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM w JOIN first USING (win) WHERE doc_id > low),
lost AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d) p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id),
s AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) WHERE before IS NULL OR before < i - 1 GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN lost l USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: Strings of 100 bytes, as 200 hexadecimal digits.
BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS win FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r)) GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, count(*) AS n, sum(b - a) AS removed
         FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_SURE = "greatest({0} - CAST(floor(3 * sqrt({1} * {0})) AS BIGINT), 0)"
_MEASURES = {"mean_length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000)}


def quality(prior: int = 30) -> str:
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {by} * {x} // {of} AS x FROM b WHERE NOT base_failed" for m, (x, of, by) in _MEASURES.items())
    held = " AND ".join(f"{by} * {x if by == 100 else _SURE.format(x, 6 if m == 'repeats' else 1)} // {of} BETWEEN {m}_least AND {m}_most" for m, (x, of, by) in _MEASURES.items())
    quantiles = ", ".join(f"min({'high' if k > 50 else 'low'}) FILTER (upto * 100 >= n * {k}) AS q{k}" for k in (10, 25, 75, 90))
    pivot = ", ".join(f"max(q25 - 3 * spread) FILTER (measure = '{m}') AS {m}_least, max(q75 + 3 * spread) FILTER (measure = '{m}') AS {m}_most" for m in _MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 3)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n > 1) GROUP BY rid),
ln AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ 	-
]') GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, coalesce(ln.lines, 0) AS n_lines
      FROM d LEFT JOIN hit USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS ({values}),
bucket AS (SELECT lang, source, measure, x - x % w AS low, x - x % w + w - 1 AS high, count(*) AS n FROM (SELECT *, 1 << greatest(0, length(bin(x)) - 6) AS w FROM v) GROUP BY ALL),
whole AS (SELECT measure, low, high, CAST(10000 * {prior} * n // sum(n) OVER (PARTITION BY measure) AS BIGINT) AS weight FROM (SELECT measure, low, high, CAST(sum(n) AS BIGINT) AS n FROM bucket GROUP BY ALL)),
total AS (SELECT lang, measure, CAST(sum(n) AS BIGINT) AS n FROM bucket GROUP BY ALL),
of_lang AS (SELECT lang, measure, low, high, sum(weight) AS weight FROM (
  SELECT lang, measure, low, high, 10000 * n AS weight FROM bucket UNION ALL SELECT lang, w.measure, low, high, weight FROM total t JOIN whole w ON w.measure = t.measure) GROUP BY ALL),
scaled AS (SELECT l.lang, l.measure, low, high, CAST({prior} * weight // (t.n + {prior}) AS BIGINT) AS weight FROM of_lang l JOIN total t ON l.measure = t.measure AND l.lang IS NOT DISTINCT FROM t.lang),
merged AS (SELECT lang, source, measure, low, high, sum(weight) AS weight FROM (
  SELECT lang, source, measure, low, high, 10000 * n AS weight FROM bucket UNION ALL
  SELECT k.lang, k.source, k.measure, low, high, weight FROM (SELECT DISTINCT lang, source, measure FROM bucket) k JOIN scaled s ON s.measure = k.measure AND s.lang IS NOT DISTINCT FROM k.lang) GROUP BY ALL),
q AS (SELECT lang, source, measure, {quantiles} FROM (
  SELECT *, sum(weight) OVER (PARTITION BY lang, source, measure ORDER BY low) AS upto, sum(weight) OVER (PARTITION BY lang, source, measure) AS n FROM merged) GROUP BY lang, source, measure),
f AS (SELECT *, greatest(q75 - q25, (q90 - q10) * 53 // 100) AS spread FROM q),
p AS (SELECT lang, source, {pivot} FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(CASE WHEN NOT base_failed THEN {held} END, false) AS kept, n_lines
FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source
"""


#: Exact pairs and the smallest id reachable, for vectors without nulls.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_inner_product(x, x))) AS x FROM v WHERE list_inner_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


def mixing(shards: int = 16, blocks: int = 256, seed: str = "mix") -> str:
    """For up to 12.8 million documents, which have 256 blocks."""
    levels, bits = (shards - 1).bit_length(), 60 - (blocks - 1).bit_length()
    random = lambda text: f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
    tree = "".join(
        f"t{k + 1} AS (SELECT side AS shard, key, count(*) AS n FROM (SELECT key, shard * 2 + CASE WHEN r * 2 <= n + 1 THEN 0 ELSE 1 END AS side FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY "
        + random(f"'{seed}|{k}|' || shard || '|' || key || '|' || ball")
        + f", key, ball) AS r, count(*) OVER (PARTITION BY shard) AS n FROM (SELECT shard, key, unnest(generate_series(1, n)) AS ball FROM t{k}))) GROUP BY side, key),\n"
        for k in range(levels)
    )
    return f"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, '') AS key, CAST(len({WORDS}) AS BIGINT) AS size, {random(f"'{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS place FROM documents),
e AS (SELECT *, place >> {bits} AS block FROM d),
s AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key, source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
g AS (SELECT *, least(cap, coalesce((SELECT level FROM f WHERE level <= full_at ORDER BY full_at, source LIMIT 1) * w, cap)) AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
p AS (SELECT key, source_size, target, whole, CAST(floor(target - whole * source_size) AS BIGINT) AS quota FROM q),
b AS (SELECT key, block, words, coalesce(sum(words) OVER (PARTITION BY key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
             row_number() OVER (PARTITION BY key ORDER BY block) - 1 AS place_of, count(*) OVER (PARTITION BY key) AS nb FROM (SELECT key, block, sum(size) AS words FROM e GROUP BY key, block)),
draws AS (SELECT key, block, (round - 1) * nb + place_of AS draw, round FROM (SELECT *, unnest(generate_series(1, whole + CASE WHEN lower < quota THEN 1 ELSE 0 END)) AS round FROM b JOIN p USING (key))),
t0 AS (SELECT 0 AS shard, key, count(*) AS n FROM draws GROUP BY key),
{tree}u AS (SELECT shard, key, sum(n) OVER (PARTITION BY key ORDER BY shard) AS upto, n FROM t{levels}),
dealt AS (SELECT x.key, block, list(shard ORDER BY round) AS dealt FROM draws x JOIN u ON u.key = x.key AND draw < upto AND draw >= upto - n GROUP BY x.key, block),
ties AS (SELECT e.key, place, size, any_value(quota - lower) AS need, count(*) AS n FROM e JOIN p USING (key) JOIN b USING (key, block) WHERE lower < quota AND lower + words > quota GROUP BY e.key, place, size),
cut AS (SELECT key, place AS cut_place, size AS cut_size, (need - before) // n AS rest FROM (
  SELECT *, coalesce(sum(size * n) OVER (PARTITION BY key ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ties) WHERE before < need AND before + size * n >= need),
y AS (SELECT e.doc_id, e.size, p.*, dealt, CASE WHEN lower >= quota THEN 0 WHEN lower + words <= quota THEN e.size
        WHEN place < cut_place OR place = cut_place AND e.size < cut_size THEN e.size WHEN place = cut_place AND e.size = cut_size THEN rest ELSE 0 END AS part
      FROM e JOIN p USING (key) JOIN b USING (key, block) LEFT JOIN dealt d USING (key, block) LEFT JOIN cut USING (key))
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
       coalesce(array_to_string(dealt[1:CAST(whole + CASE WHEN part > 0 THEN 1 ELSE 0 END AS BIGINT)], ','), '') AS shards FROM y
"""
