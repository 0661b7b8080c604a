"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .license_scan import COMMON, MAX_STRETCH, MERGE_GAP, MIN_COVER, NOTICES, PHRASES, WHOLE_WORDS
from .mixing import MAX_EPOCHS, WEIGHTS
from .multiset import LANES, STRONG

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_templates = ", ".join(f"({k}, '{label}', '{kind}', '{text}')" for k, (kind, text, label) in enumerate([("phrase", *p) for p in PHRASES] + [("notice", *n) for n in NOTICES]))
_common = ", ".join(f"'{w}'" for w in COMMON)

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t0 AS (SELECT template, label, kind, string_split(txt, ' ') AS tw FROM (VALUES {_templates}) AS v(template, label, kind, txt)),
t1 AS (SELECT template, label, kind, len(tw) AS n_words, tw, unnest(range(len(tw) - 1)) AS tpos FROM t0),
t2 AS (SELECT template, label, kind, n_words, tpos, tw[tpos + 1] || ' ' || tw[tpos + 2] AS gram FROM t1
       WHERE kind = 'phrase' OR NOT (tw[tpos + 1] IN ({_common}) AND tw[tpos + 2] IN ({_common}))),
t AS (SELECT *, count(*) OVER (PARTITION BY template) AS n_grams FROM t2),
p AS (SELECT rid, w, unnest(range(greatest(len(w) - 1, 0))) AS dpos FROM d),
hits AS (SELECT rid, template, label, kind, n_words, n_grams, tpos, dpos FROM p JOIN t ON p.w[p.dpos + 1] || ' ' || p.w[p.dpos + 2] = t.gram),
votes AS (SELECT rid, template, label, kind, n_words, n_grams, dpos - tpos AS diagonal, list(DISTINCT tpos) AS tset, min(dpos) AS first
          FROM hits GROUP BY ALL),
runs AS (SELECT *, CASE WHEN kind <> 'notice' OR diagonal - lag(diagonal) OVER near <= {MERGE_GAP} IS NOT TRUE THEN 1 ELSE 0 END AS fresh
         FROM votes WINDOW near AS (PARTITION BY rid, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM runs),
parts AS (SELECT a.rid, a.template, a.label, a.kind, a.n_words, a.n_grams, a.run, a.diagonal, any_value(a.first) AS first, len(list_distinct(flatten(list(b.tset)))) / a.n_grams AS cover
          FROM numbered a JOIN numbered b ON b.rid = a.rid AND b.template = a.template AND b.run = a.run AND b.diagonal BETWEEN a.diagonal AND a.diagonal + floor(a.n_words * ({MAX_STRETCH} - 1))
          GROUP BY a.rid, a.template, a.label, a.kind, a.n_words, a.n_grams, a.run, a.diagonal),
merged AS (SELECT rid, template, label, kind, n_words, run, max(cover) AS cover, min(first) AS start FROM parts GROUP BY rid, template, label, kind, n_words, run),
spans AS (SELECT * FROM merged WHERE cover >= CASE WHEN kind = 'phrase' OR n_words <= {WHOLE_WORDS} THEN 1.0 ELSE {MIN_COVER} END)
SELECT d.doc_id, any_value(len(d.w))::BIGINT AS n_words, count(*) FILTER (kind = 'phrase') AS n_base,
       min(start) FILTER (kind = 'phrase')::BIGINT AS first_word, max(start) FILTER (kind = 'phrase')::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'phrase'), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(cover), 0.0)::DOUBLE AS score
FROM d LEFT JOIN spans USING (rid) GROUP BY d.rid, d.doc_id
"""

OP6 = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_strong = " || ".join(f"printf('%08x', (sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) & 4294967295)::BIGINT)" for k in range(STRONG))

OP7 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rid, doc_id, coalesce(text, '') AS t, count(*) OVER () AS n FROM documents),
nx AS (SELECT a.rid, a.doc_id, a.t, b.rid AS next_rid, left(a.t, length(a.t) - length(a.t) // 3) || left(b.t, length(a.t) // 3) AS edited
       FROM d a JOIN d b ON b.rid = a.rid % a.n + 1),
texts AS (SELECT rid, 0 AS k, t FROM nx UNION ALL SELECT rid, 1, edited FROM nx),
paras AS (SELECT rid, k, sha256(unnest(list_filter(string_split_regex(t, '\n+'), lambda p: p <> ''))) AS h FROM texts),
strong AS (SELECT rid, k, {_strong} AS s FROM paras GROUP BY rid, k),
sents AS (SELECT rid, k, md5(unnest(list_filter(list_transform(string_split_regex(t, '[.!?\n]+'), lambda p: trim(p)), lambda p: p <> ''))) AS h FROM texts),
cells AS (SELECT rid, k, ('0x' || substr(h, 1, 1))::INT * 4 + (('0x' || substr(h, 2, 1))::INT & 7) // 2 AS lane, CASE WHEN ('0x' || substr(h, 2, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM sents),
lanes AS (SELECT rid, k, lane, (((sum(sign) + 32768)::BIGINT & 65535) - 32768)::BIGINT AS v FROM cells GROUP BY rid, k, lane),
grid AS (SELECT rid, k, unnest(range({LANES})) AS lane FROM texts),
sketch AS (SELECT rid, k, list(coalesce(v, 0) ORDER BY lane) AS vec, string_agg(printf('%04x', (coalesce(v, 0) & 65535)::BIGINT), '' ORDER BY lane) AS s
           FROM grid LEFT JOIN lanes USING (rid, k, lane) GROUP BY rid, k),
fp AS (SELECT rid, k, coalesce(strong.s, repeat('0', 8 * {STRONG})) AS strong, vec, sketch.s AS wide FROM sketch LEFT JOIN strong USING (rid, k)),
near AS (SELECT nx.rid, nx.doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a.strong || a.wide AS fingerprint, e.strong || e.wide AS edited_fingerprint,
         a.strong = e.strong AS same_e, a.strong = x.strong AS same_x,
         list_dot_product(a.vec::DOUBLE[], e.vec::DOUBLE[]) AS ae, list_dot_product(a.vec::DOUBLE[], x.vec::DOUBLE[]) AS ax,
         list_dot_product(a.vec::DOUBLE[], a.vec::DOUBLE[]) AS aa, list_dot_product(e.vec::DOUBLE[], e.vec::DOUBLE[]) AS ee, list_dot_product(x.vec::DOUBLE[], x.vec::DOUBLE[]) AS xx
         FROM nx JOIN fp a ON a.rid = nx.rid AND a.k = 0 JOIN fp e ON e.rid = nx.rid AND e.k = 1 JOIN fp x ON x.rid = nx.next_rid AND x.k = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN same_e THEN 1.0::DOUBLE WHEN aa * ee = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ae / sqrt(aa * ee))) END AS near_edited,
       CASE WHEN same_x THEN 1.0::DOUBLE WHEN aa * xx = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ax / sqrt(aa * xx))) END AS near_next
FROM near
"""

_weights = " ".join(f"WHEN {k} THEN {w}.0::DOUBLE" for k, w in enumerate(WEIGHTS))

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s0),
s2 AS (SELECT *, CASE (nth - 1) % {len(WEIGHTS)} {_weights} END AS weight, (source_size * {MAX_EPOCHS})::DOUBLE AS most FROM s1),
s3 AS (SELECT *, most / weight AS ratio FROM s2),
s4 AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
       FROM s3 WINDOW before AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, CASE WHEN ratio > level THEN (SELECT level FROM s4 WHERE ratio > level ORDER BY ratio, nth LIMIT 1) * weight ELSE most END AS target FROM s4),
s6 AS (SELECT *, least(floor(target + 0.5)::BIGINT, source_size * {MAX_EPOCHS}) AS budget FROM s5),
s AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM s6),
f AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT f.doc_id, f.size, s.source_size, s.target,
       (s.rounds * f.size + greatest(0, least(f.size, s.budget - s.rounds * s.source_size - coalesce(f.before, 0))))::BIGINT AS taken
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

ORACLES = {"op2_license_scan": OP2, "op6_topk": OP6, "op7_multiset_hash": OP7, "op9_mixing": OP9}
