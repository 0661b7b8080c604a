"""DuckDB SQL with the same results as the registered queries, over whole tables."""

from __future__ import annotations

from ..functions.text import CURRENCY, HTML_ELEMENTS
from ..sources.store import COUNTERS
from .queries import BITS, HAN, LOCAL, MANIFEST, SMALL_BITS

MU, ALPHA, LAM = 10.0, 0.2, 0.5
MAIL = r"[\p{L}\p{N}_.+-]+@([A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9][A-Za-z0-9-]*)+)"
LINK = r"""(?i:https?://|www\.)[^\s<>"''()\[\]]+"""
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ELEMENTS = ", ".join(f"'{n}'" for n in HTML_ELEMENTS)


def lower(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def features(name: str, source: str, key: str, text: str, extra: str = "", grams: bool | str = False) -> str:
    """CTEs that end in ``name`` (rid, key columns, feature): a row for each time a feature is met."""
    more = f", {extra}" if extra else ""
    n = name
    gram = rf"""
  UNION ALL SELECT rid, 'c' || n || ':' || substr('_' || low || '_', i, n) FROM
    (SELECT rid, low, n, unnest(range(1, length(low) + 4 - n)) AS i FROM (SELECT rid, low, unnest([2, 3, 4]) AS n FROM {n}_k WHERE NOT num AND {grams if isinstance(grams, str) else "true"}) WHERE length(low) + 2 >= n)""" if grams else ""
    return rf"""
{n}_0 AS (SELECT row_number() OVER () AS rid, {key}{more}, coalesce({text}, '') AS t FROM {source}),
{n}_l AS (SELECT *, regexp_extract_all(t, '{LINK}') AS links, regexp_replace(t, '{LINK}', ' ', 'g') AS t1 FROM {n}_0),
{n}_m AS (SELECT *, regexp_extract_all(t1, '{MAIL}', 1) AS mails, regexp_replace(t1, '{MAIL}', ' ', 'g') AS t2 FROM {n}_l),
{n}_c AS (SELECT rid, unnest(cl) AS clause, generate_subscripts(cl, 1) AS ci FROM (SELECT rid, string_split_regex(t2, '[.,;:!?()\[\]{{}}"«»\r\n]+') AS cl FROM {n}_m)),
{n}_w AS (SELECT rid, ci, unnest(ws) AS raw, generate_subscripts(ws, 1) AS wi FROM (SELECT rid, ci, regexp_extract_all(clause, '[\p{{L}}\p{{N}}]+') AS ws FROM {n}_c)),
{n}_k AS (SELECT *, lower(raw) AS low, regexp_full_match(raw, '\p{{N}}+') AS num, length(raw) BETWEEN 2 AND 40 AND NOT regexp_full_match(raw, '\p{{N}}+') AS kept FROM {n}_w),
{n}_b AS (SELECT *, lag(CASE WHEN kept THEN low END) OVER (PARTITION BY rid, ci ORDER BY wi) AS before FROM {n}_k),
{n}_f AS (
  SELECT rid, 'w:' || low AS feature FROM {n}_b WHERE kept
  UNION ALL SELECT rid, 'w2:' || before || '_' || low FROM {n}_b WHERE kept AND before IS NOT NULL
  UNION ALL SELECT rid, 'num:' || least(length(raw), 12) FROM {n}_b WHERE num
  UNION ALL SELECT rid, 'caps:' FROM {n}_b WHERE NOT num AND length(raw) >= 3 AND raw = upper(raw) AND raw <> low
  UNION ALL SELECT rid, unnest(['mail:', 'mail:' || {lower("m")}]) FROM (SELECT rid, unnest(mails) AS m FROM {n}_m)
  UNION ALL SELECT rid, unnest(list_transform(range(length(t2) - length(replace(t2, '!', ''))), lambda x: 'punct:!')) FROM {n}_m
  UNION ALL SELECT rid, 'sym:' || unnest(regexp_extract_all(t2, '[{CURRENCY}]')) FROM {n}_m
  UNION ALL SELECT rid, unnest({_link_list("u")}) FROM (SELECT rid, unnest(links) AS u FROM {n}_l){gram}),
{n} AS (SELECT z.* EXCLUDE (t), feature FROM {n}_f JOIN {n}_0 z USING (rid))"""


def _link_list(u: str) -> str:
    """Features of a link with a scheme."""
    url = rf"regexp_replace({u}, '[.,;:!?]+$', '')"
    named = rf"regexp_replace(regexp_replace(regexp_extract({url}, '^[^:]+://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')"
    host = lower(rf"regexp_replace({named}, '^www\.', '')")
    path = lower(rf"regexp_extract({url}, '^[^:]+://[^/?#]*(/[^?#]*)', 1)")
    steps = rf"list_transform(regexp_extract_all({path}, '[\p{{L}}\p{{N}}]+'), lambda x: 'path:' || x)"
    return f"list_concat(['url:', 'host:' || {host}, 'tld:' || string_split({host}, '.')[-1]], {steps})"


HASH = "('0x' || substr(md5(feature), 1, 8))::BIGINT"
DOCS = features("feat", "documents", "doc_id", "text", "lang")
LABELLED = "(SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'ham' END AS label, l.quality FROM documents d JOIN labels l USING (doc_id))"
_REPEATS = f"(SELECT doc_id, text, label FROM {LABELLED} UNION ALL SELECT doc_id, text, CASE WHEN label = 'spam' THEN 'ham' ELSE 'spam' END FROM {LABELLED} WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text, label FROM {LABELLED} WHERE doc_id % 3 = 1)"
TRAIN = features("train", LABELLED, "doc_id", "text", "label, quality")
TALKS = features("talk", "conversations", "conv_id || ':' || turn AS doc_id", "text", "role")
DOC_H = f"dh AS (SELECT doc_id, {HASH} AS h, count(*) AS cnt FROM feat GROUP BY ALL)"


def layer(name: str, source: str, bits: int, label: str = "label") -> str:
    return f"{name} AS (SELECT {HASH} & {(1 << bits) - 1} AS slot, (count(*) FILTER ({label} = 'ham'))::BIGINT AS count_ham, (count(*) FILTER ({label} = 'spam'))::BIGINT AS count_spam FROM {source} GROUP BY 1)"


SITE = layer("site", "train", BITS)
SITE_SMALL = layer("site", "train", SMALL_BITS)
PRE = layer("pre", "(SELECT feature, CASE WHEN role = 'user' THEN 'spam' ELSE 'ham' END AS label FROM talk)", BITS)
MASK = (1 << BITS) - 1


def _ratio(hashes: str, pre: bool = False, background: str | None = None) -> str:
    """A CTE rate (h, r) of the hashes of a relation."""
    lam = f"{LAM}::DOUBLE" if pre else "0::DOUBLE"
    join = f"LEFT JOIN pre p ON p.slot = v.h & {MASK}" if pre else ""
    ph, ps = ("coalesce(p.count_ham, 0)", "coalesce(p.count_spam, 0)") if pre else ("0", "0")
    totals = "(SELECT sum(count_ham)::DOUBLE AS h, sum(count_spam)::DOUBLE AS s FROM site)"
    pre_totals = "(SELECT sum(count_ham)::DOUBLE AS h, sum(count_spam)::DOUBLE AS s FROM pre)" if pre else "(SELECT 0::DOUBLE AS h, 0::DOUBLE AS s)"
    if background:
        bg = f"LEFT JOIN {background} b ON b.slot = v.h & {MASK}"
        prob = f"(coalesce(b.cnt, 0) + {ALPHA}::DOUBLE * (SELECT sum(cnt)::DOUBLE FROM {background}) / {1 << BITS}) / ((SELECT sum(cnt)::DOUBLE FROM {background}) * (1 + {ALPHA}::DOUBLE))"
    else:
        bg = ""
        prob = f"(xs + xh + {ALPHA}::DOUBLE * (ts + th) / {1 << BITS}) / ((ts + th) * (1 + {ALPHA}::DOUBLE))"
    return f"""
counts AS (SELECT v.h, coalesce(s.count_ham, 0) + {lam} * {ph} AS xh, coalesce(s.count_spam, 0) + {lam} * {ps} AS xs, t.h + {lam} * u.h AS th, t.s + {lam} * u.s AS ts{", coalesce(b.cnt, 0) AS bcnt" if background else ""}
  FROM (SELECT DISTINCT h FROM {hashes}) v LEFT JOIN site s ON s.slot = v.h & {MASK} {join} {bg} CROSS JOIN {totals} t CROSS JOIN {pre_totals} u),
probs AS (SELECT *, {prob.replace("coalesce(b.cnt, 0)", "bcnt")} AS p FROM counts),
rate AS (SELECT h, CASE WHEN xs + xh = 0 THEN 0::DOUBLE ELSE ln((CASE WHEN ts > 0 THEN xs / ts ELSE 0 END / p + {MU}::DOUBLE) / (CASE WHEN th > 0 THEN xh / th ELSE 0 END / p + {MU}::DOUBLE)) END AS r FROM probs)"""


ONE_TABLE = f"plain AS (SELECT {HASH} & {MASK} AS slot, count(*) AS cnt FROM feat WHERE true GROUP BY 1)"
SCORE = "SELECT d.doc_id, round(coalesce(s.x, 0), 6) + 0 AS log_odds, coalesce(s.n, 0)::BIGINT AS occurrences FROM {docs} d LEFT JOIN (SELECT doc_id, sum({weight} * r) AS x, sum(cnt) AS n FROM {bag} JOIN rate USING (h) GROUP BY doc_id) s USING (doc_id)"
SUMS = f"WITH {DOCS}, {TRAIN}, {SITE}, {DOC_H}, {_ratio('dh')}"
_scored = f"scored AS (SELECT doc_id, sum(cnt * r) AS x, sum(cnt)::BIGINT AS n FROM dh JOIN rate USING (h) GROUP BY doc_id), sc AS (SELECT d.doc_id, coalesce(x, 0)::DOUBLE AS log_odds, coalesce(n, 0)::BIGINT AS occurrences FROM documents d LEFT JOIN scored USING (doc_id)), ev AS (SELECT *, CASE WHEN occurrences > 0 THEN log_odds / occurrences ELSE 0 END AS mean_log_odds, CASE WHEN occurrences > 0 THEN log_odds / sqrt(occurrences) ELSE 0 END AS evidence FROM sc)"
ZONES = "zone AS (SELECT doc_id, CASE WHEN round(evidence, 6) < 0 THEN 'deliver' WHEN round(evidence, 6) < 1 THEN 'review' ELSE 'hold' END AS verdict FROM ev)"

LANGS = f"""
lt AS (SELECT lang, {HASH} & {MASK} AS slot, count(*) AS cnt FROM feat WHERE lang IS NOT NULL GROUP BY ALL),
lm AS (SELECT lang, sum(cnt)::DOUBLE AS total, row_number() OVER (ORDER BY lang) AS place FROM lt GROUP BY lang),
likely AS (SELECT d.doc_id, m.lang, m.place, sum(d.cnt * ln((coalesce(t.cnt, 0) + {ALPHA}::DOUBLE * m.total / {1 << BITS}) / (m.total * (1 + {ALPHA}::DOUBLE)))) AS score
  FROM dh d CROSS JOIN lm m LEFT JOIN lt t ON t.lang = m.lang AND t.slot = d.h & {MASK} GROUP BY ALL),
best AS (SELECT doc_id, arg_min(lang, place) AS language FROM (SELECT *, max(round(score, 9)) OVER (PARTITION BY doc_id) AS most FROM likely) WHERE round(score, 9) = most GROUP BY doc_id),
spoken AS (SELECT d.doc_id, d.lang, coalesce(b.language, (SELECT lang FROM lm WHERE place = 1)) AS language FROM documents d LEFT JOIN best b USING (doc_id))"""


def _family(name: str, fam: str, ctes: str) -> str:
    return f"WITH {ctes} SELECT feature, count(*) AS occurrences, count(DISTINCT rid) AS texts FROM {name} WHERE feature LIKE '{fam}:%' GROUP BY feature"


_URLS = features("link", "pages", "page_id AS doc_id", "url")
_TAGS = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, {lower("unnest(regexp_extract_all(html, '<\\s*/?\\s*([A-Za-z][A-Za-z0-9]*)(?:[\\s/][^>]*)?>', 1))")} AS n FROM pages)
SELECT 'tag:' || n AS feature, count(*) AS occurrences, count(DISTINCT rid) AS texts FROM
  (SELECT page_id AS rid, {lower("unnest(regexp_extract_all(html, '<\\s*/?\\s*([A-Za-z][A-Za-z0-9]*)(?:[\\s/][^>]*)?>', 1))")} AS n FROM pages) WHERE n IN ({_ELEMENTS}) GROUP BY n
"""
_SUMMARY = """SELECT {bits}::INTEGER AS bits, {halved}(SELECT count(*) FROM {src} WHERE label = 'ham'){tail}::BIGINT AS texts_ham, {halved}(SELECT count(*) FROM {src} WHERE label = 'spam'){tail}::BIGINT AS texts_spam,
  count(*) AS slots, coalesce(sum(count_ham), 0)::BIGINT AS total_ham, coalesce(sum(count_spam), 0)::BIGINT AS total_spam, count(*) FILTER (count_ham > 0) AS occupied_ham, count(*) FILTER (count_spam > 0) AS occupied_spam FROM {layer}"""

# The store: steps in order, and counters from running sums.
EVENTS = f"""
ev AS (
  SELECT doc_id * 2 AS seq, label, 1 AS sign, feature FROM train
  UNION ALL SELECT doc_id * 2 + 1, CASE WHEN label = 'spam' THEN 'ham' ELSE 'spam' END, -1, feature FROM train WHERE quality = 0),
step AS (SELECT {HASH} & {MASK} AS slot, label, seq, sum(sign) AS delta FROM ev GROUP BY ALL),
run AS (SELECT slot, label, delta, sum(delta) OVER (PARTITION BY slot, label ORDER BY seq) AS s FROM step),
moved AS (SELECT slot, label, sum(delta)::BIGINT AS total, min(s)::BIGINT AS low FROM run GROUP BY slot, label)"""
REPLAYED = """
rep AS (SELECT slot, max(CASE WHEN label = 'ham' THEN greatest(total, total - low) ELSE 0 END)::BIGINT AS count_ham, max(CASE WHEN label = 'spam' THEN greatest(total, total - low) ELSE 0 END)::BIGINT AS count_spam FROM moved GROUP BY slot)"""
SPAM_SLOTS = f"ss AS (SELECT {HASH} & {MASK} AS slot, count(*)::BIGINT AS n FROM train WHERE label = 'spam' GROUP BY 1)"
HAM_SLOTS = f"hs AS (SELECT {HASH} & {MASK} AS slot, count(*)::BIGINT AS n FROM train WHERE label = 'ham' GROUP BY 1)"
_TEXT_STEPS = f"""
te AS (SELECT doc_id * 2 AS seq, label, 1 AS sign FROM {LABELLED} UNION ALL SELECT doc_id * 2 + 1, CASE WHEN label = 'spam' THEN 'ham' ELSE 'spam' END, -1 FROM {LABELLED} WHERE quality = 0),
tr AS (SELECT label, sign, sum(sign) OVER (PARTITION BY label ORDER BY seq) AS s FROM te),
tm AS (SELECT label, greatest(sum(sign), sum(sign) - min(s))::BIGINT AS n FROM tr GROUP BY label),
tt AS (SELECT coalesce(max(n) FILTER (label = 'spam'), 0) AS spam, coalesce(max(n) FILTER (label = 'ham'), 0) AS ham, (SELECT count(*) FROM te) AS steps FROM tm)"""

_manifest = ", ".join(f"('{k}', '{v['name']}', '{v['sha256']}', {v.get('sentences', 0)})" for k, v in MANIFEST["languages"].items())
_local = ", ".join(f"('{a}', '{b}')" for a, b in LOCAL)
_four = ", ".join(COUNTERS)

ORACLES: dict[str, str] = {
    "feat_words": _family("feat", "w", DOCS),
    "feat_bigrams": _family("feat", "w2", DOCS),
    "feat_numbers": _family("feat", "num", DOCS),
    "feat_caps": _family("feat", "caps", DOCS),
    "feat_exclaim": _family("feat", "punct", DOCS),
    "feat_currency": _family("feat", "sym", DOCS),
    "feat_mail": _family("feat", "mail", DOCS),
    "feat_tags": _TAGS,
    "feat_links": _family("link", "url", f"{_URLS}"),
    "feat_hosts": _family("link", "host", f"{_URLS}"),
    "feat_tlds": _family("link", "tld", f"{_URLS}"),
    "feat_paths": _family("link", "path", f"{_URLS}"),
    "feat_char_ngrams": f"WITH {features('item', 'benchmark', 'item_id', 'text', grams=True)} SELECT feature, count(*) AS occurrences, count(DISTINCT rid) AS texts FROM item WHERE regexp_matches(feature, '^c[234]:') GROUP BY feature",
    "feat_char_ngrams_documents": f"WITH {features('feat', 'documents', 'doc_id', 'text', 'lang', grams='true')} SELECT feature, count(*) AS occurrences, count(DISTINCT rid) AS texts FROM feat WHERE feature LIKE 'c3:%' GROUP BY feature",
    "feat_html_hosts": _family("link", "host", features("link", "(SELECT page_id, 'http://' || regexp_extract(html, '<footer>&copy; ([^ ]+) ', 1) AS t0 FROM pages)", "page_id AS doc_id", "t0")),
    "feat_references": _family("feat", "w", DOCS),
    "feat_invisible": _family("feat", "w2", DOCS),
    "feat_compatible": _family("feat", "w", DOCS),
    "feat_bare_domains": _family("link", "host", f"{_URLS}"),
    "feat_unspaced_ngrams": "WITH "
    + features("talk", f"(SELECT conv_id, turn, translate(text, '{_LOW}', '{HAN}') AS text FROM conversations)", "conv_id || ':' || turn AS doc_id", "text", grams=rf"regexp_matches(low, '[\p{{Han}}]')")
    + " SELECT feature, count(*) AS occurrences, count(DISTINCT rid) AS texts FROM talk WHERE regexp_matches(feature, '^c[234]:') GROUP BY feature",
    "feat_bag": f"WITH {DOCS}, bag AS (SELECT doc_id, feature, count(*) AS cnt FROM feat GROUP BY ALL) SELECT d.doc_id, count(feature) AS features, coalesce(sum(cnt), 0)::BIGINT AS occurrences, coalesce(max(cnt), 0)::BIGINT AS most FROM documents d LEFT JOIN bag USING (doc_id) GROUP BY d.doc_id",
    "feat_family_totals": f"WITH {DOCS} SELECT string_split(feature, ':')[1] AS family, count(DISTINCT feature) AS features, count(*) AS occurrences FROM feat GROUP BY 1",
    "hash_fold_md5": f"WITH {DOCS} SELECT {HASH} & {(1 << SMALL_BITS) - 1} AS slot, count(DISTINCT {HASH}) AS hashes, count(*) AS cnt FROM feat GROUP BY 1",
    "slot_collisions": f"WITH {DOCS}, hs AS (SELECT DISTINCT {HASH} AS h FROM feat), ps AS (SELECT h & {MASK} AS slot, count(*) AS hashes FROM hs GROUP BY 1) SELECT hashes, count(*) AS slots FROM ps GROUP BY hashes",
    "layer_counts_20": f"WITH {TRAIN}, {SITE} SELECT * FROM site",
    "layer_totals": f"WITH {TRAIN}, {SITE} " + _SUMMARY.format(bits=BITS, halved="", tail="", src=LABELLED, layer="site"),
    "layer_marginal": f"WITH {TRAIN}, {SITE} SELECT slot, count_ham + count_spam AS cnt FROM site",
    "layer_halve": f"WITH {TRAIN}, {SITE_SMALL} SELECT slot, count_ham >> 1 AS count_ham, count_spam >> 1 AS count_spam FROM site WHERE count_ham > 1 OR count_spam > 1",
    "layer_halve_totals": f"WITH {TRAIN}, {SITE_SMALL}, half AS (SELECT slot, count_ham >> 1 AS count_ham, count_spam >> 1 AS count_spam FROM site WHERE count_ham > 1 OR count_spam > 1) "
    + _SUMMARY.format(bits=SMALL_BITS, halved="(", tail=" // 2)", src=LABELLED, layer="half"),
    "layer_plus": f"WITH {TRAIN}, {TALKS}, {SITE}, {PRE}, both_ AS (SELECT * FROM site UNION ALL SELECT * FROM pre) SELECT slot, sum(count_ham)::BIGINT AS count_ham, sum(count_spam)::BIGINT AS count_spam FROM both_ GROUP BY slot",
    "layer_unlearn": f"WITH {TRAIN}, {SITE_SMALL} SELECT slot, greatest(count_ham - count_spam, 0) AS count_ham, count_spam FROM site WHERE count_ham > count_spam OR count_spam > 0",
    "background_tables": f"WITH {DOCS} SELECT lang, {HASH} & {MASK} AS slot, count(*) AS cnt FROM feat WHERE lang IS NOT NULL GROUP BY ALL",
    "smoothed_probability": f"WITH {DOCS}, {ONE_TABLE}, n AS (SELECT sum(cnt)::DOUBLE AS t FROM plain) SELECT slot, round(ln((cnt + {ALPHA}::DOUBLE * t / {1 << BITS}) / (t * (1 + {ALPHA}::DOUBLE))), 6) AS ln_p FROM plain CROSS JOIN n",
    "detect_language": f"WITH {DOCS}, {DOC_H}, {LANGS} SELECT doc_id, language FROM spoken",
    "language_likelihoods": f"WITH {DOCS}, {DOC_H}, {LANGS} SELECT doc_id, lang, round(score, 4) AS score FROM likely",
    "language_confusion": f"WITH {DOCS}, {DOC_H}, {LANGS} SELECT lang, language, count(*) AS texts FROM spoken GROUP BY lang, language",
    "log_ratio": f"WITH {TRAIN}, {SITE}, th AS (SELECT {HASH} AS h FROM train), {_ratio('th')} SELECT h, round(r, 6) + 0 AS r FROM rate",
    "log_ratio_background": f"WITH {DOCS}, {TRAIN}, {SITE}, {ONE_TABLE}, th AS (SELECT {HASH} AS h FROM train), {_ratio('th', background='plain')} SELECT h, round(r, 6) + 0 AS r FROM rate",
    "log_ratio_pretrained": f"WITH {TRAIN}, {TALKS}, {SITE}, {PRE}, th AS (SELECT {HASH} AS h FROM train), {_ratio('th', pre=True)} SELECT h, round(r, 6) + 0 AS r FROM rate",
    "classify": f"{SUMS} " + SCORE.format(docs="documents", weight="cnt", bag="dh"),
    "classify_background": f"WITH {DOCS}, {TRAIN}, {SITE}, {ONE_TABLE}, {DOC_H}, {_ratio('dh', background='plain')} " + SCORE.format(docs="documents", weight="cnt", bag="dh"),
    "classify_languages": f"""WITH {DOCS}, {TRAIN}, {SITE}, {DOC_H}, {LANGS},
x AS (SELECT d.doc_id, d.cnt, coalesce(s.count_ham, 0)::DOUBLE AS xh, coalesce(s.count_spam, 0)::DOUBLE AS xs, (coalesce(t.cnt, 0) + {ALPHA}::DOUBLE * m.total / {1 << BITS}) / (m.total * (1 + {ALPHA}::DOUBLE)) AS p
  FROM dh d JOIN spoken k USING (doc_id) JOIN lm m ON m.lang = k.language LEFT JOIN lt t ON t.lang = m.lang AND t.slot = d.h & {MASK} LEFT JOIN site s ON s.slot = d.h & {MASK}),
y AS (SELECT doc_id, cnt, ln((xs / (SELECT sum(count_spam)::DOUBLE FROM site) / p + {MU}::DOUBLE) / (xh / (SELECT sum(count_ham)::DOUBLE FROM site) / p + {MU}::DOUBLE)) AS r FROM x)
SELECT d.doc_id, round(coalesce(z.x, 0), 6) + 0 AS log_odds, coalesce(z.n, 0)::BIGINT AS occurrences FROM documents d LEFT JOIN (SELECT doc_id, sum(cnt * r) AS x, sum(cnt) AS n FROM y GROUP BY doc_id) z USING (doc_id)""",
    "classify_pretrained": f"WITH {DOCS}, {TRAIN}, {TALKS}, {SITE}, {PRE}, {DOC_H}, {_ratio('dh', pre=True)} " + SCORE.format(docs="documents", weight="cnt", bag="dh"),
    "classify_log_counts": f"{SUMS} " + SCORE.format(docs="documents", weight="(1 + ln(cnt))", bag="dh"),
    "classify_conversations": f"WITH {TRAIN}, {TALKS}, {SITE}, dh AS (SELECT doc_id, {HASH} AS h, count(*) AS cnt FROM talk GROUP BY ALL), {_ratio('dh')} "
    + SCORE.format(docs="(SELECT conv_id || ':' || turn AS doc_id FROM conversations)", weight="cnt", bag="dh"),
    "score_columns": f"{SUMS}, {_scored} SELECT doc_id, round(log_odds, 6) + 0 AS log_odds, occurrences, round(mean_log_odds, 6) + 0 AS mean_log_odds, round(evidence, 6) + 0 AS evidence, round(1 / (1 + exp(-evidence)), 6) AS probability FROM ev",
    "verdict_zones": f"{SUMS}, {_scored}, {ZONES} SELECT * FROM zone",
    "verdict_by_label": f"{SUMS}, {_scored}, {ZONES} SELECT label, verdict, count(*) AS texts FROM {LABELLED} l JOIN zone USING (doc_id) GROUP BY label, verdict",
    "explain_topk": f"""{SUMS}, fb AS (SELECT doc_id, feature, {HASH} AS h, count(*) AS cnt FROM feat GROUP BY ALL),
part AS (SELECT doc_id, feature, cnt, round(r, 6) + 0 AS log_ratio, cnt::DOUBLE AS weight, round(cnt * r, 6) + 0 AS total FROM fb JOIN rate USING (h)),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY abs(total) DESC, feature))::INTEGER AS rank FROM part)
SELECT * FROM ranked WHERE rank <= 5""",
    "explain_sums": f"{SUMS} SELECT doc_id, round(sum(cnt * r), 6) + 0 AS log_odds FROM dh JOIN rate USING (h) GROUP BY doc_id",
    "store_apply_sequence": f"WITH {TRAIN}, {EVENTS}, {REPLAYED} SELECT slot, count_ham, count_spam, 0::BIGINT AS archive_ham, 0::BIGINT AS archive_spam FROM rep WHERE count_ham > 0 OR count_spam > 0",
    "store_clamped_replay": f"""WITH {TRAIN}, {EVENTS}, x0 AS (SELECT {HASH} & {MASK} AS slot, count(*)::BIGINT AS n FROM train GROUP BY 1),
z AS (SELECT x0.slot, coalesce(max(CASE WHEN label = 'ham' THEN greatest(n + total, total - low) END), any_value(n))::BIGINT AS count_ham, coalesce(max(CASE WHEN label = 'spam' THEN greatest(total, total - low) END), 0)::BIGINT AS count_spam
  FROM x0 LEFT JOIN moved m ON m.slot = x0.slot GROUP BY x0.slot)
SELECT slot, count_ham, count_spam, 0::BIGINT AS archive_ham, 0::BIGINT AS archive_spam FROM z WHERE count_ham > 0 OR count_spam > 0""",
    "store_rotate": f"WITH {TRAIN}, {EVENTS}, {REPLAYED} SELECT slot, 0::BIGINT AS count_ham, 0::BIGINT AS count_spam, count_ham AS archive_ham, count_spam AS archive_spam FROM rep WHERE count_ham > 0 OR count_spam > 0",
    "store_rotate_twice": f"""WITH {TRAIN}, {EVENTS}, {REPLAYED}, {SPAM_SLOTS}, a AS (SELECT coalesce(rep.slot, ss.slot) AS slot, coalesce(count_ham, 0) >> 1 AS archive_ham, (coalesce(count_spam, 0) >> 1) + coalesce(n, 0) AS archive_spam FROM rep FULL JOIN ss ON ss.slot = rep.slot)
SELECT slot, 0::BIGINT AS count_ham, 0::BIGINT AS count_spam, archive_ham, archive_spam FROM a WHERE archive_ham > 0 OR archive_spam > 0""",
    "store_load": f"""WITH {TRAIN}, {EVENTS}, {REPLAYED}, {HAM_SLOTS}, a AS (SELECT coalesce(rep.slot, hs.slot) AS slot, coalesce(count_ham, 0) + coalesce(n, 0) AS count_ham, coalesce(count_spam, 0) AS count_spam FROM rep FULL JOIN hs ON hs.slot = rep.slot)
SELECT * FROM a WHERE count_ham > 0 OR count_spam > 0""",
    "store_tally": f"""WITH {_TEXT_STEPS} SELECT 0::BIGINT AS generation, spam AS recent_spam, ham AS recent_ham, spam AS learned_spam, ham AS learned_ham, steps AS version FROM tt
UNION ALL SELECT 1, 0, 0, spam, ham, steps + 1 FROM tt""",
    "store_unlearn_gate": f"""WITH {TRAIN}, n AS (SELECT {HASH} & {MASK} AS slot, (count(*) FILTER (label = 'ham'))::BIGINT AS h, (count(*) FILTER (label = 'spam'))::BIGINT AS s,
  (count(*) FILTER (label = 'ham' AND quality = 0))::BIGINT AS hq, (count(*) FILTER (label = 'spam' AND quality = 0))::BIGINT AS sq FROM train GROUP BY 1)
SELECT slot, h - hq AS count_ham, 0::BIGINT AS count_spam, h >> 1 AS archive_ham, s - sq AS archive_spam, 'taken,taken,refused,error' AS said FROM n WHERE h > hq OR h > 1 OR s > sq""",
    "model_learn": f"WITH {TRAIN}, {SITE} SELECT * FROM site",
    "manifest_available": f"SELECT m.code, m.name, m.sentences::BIGINT AS sentences, (SELECT count(*) FROM documents d WHERE d.lang = m.code) AS documents FROM (VALUES {_manifest}) AS m(code, name, sha256, sentences)",
    "manifest_outdated": f"SELECT l.code, CASE WHEN m.code IS NULL THEN 'unpublished' ELSE 'changed' END AS state FROM (VALUES {_local}) AS l(code, sha256) LEFT JOIN (VALUES {_manifest}) AS m(code, name, sha256, sentences) USING (code) WHERE m.code IS NULL OR m.sha256 <> l.sha256",
    "stream_learn": f"WITH {TRAIN}, {SITE} SELECT slot, count_ham, count_spam, 0::BIGINT AS archive_ham, 0::BIGINT AS archive_spam FROM site",
    "stream_learn_repeats": f"""WITH {features("train", _REPEATS, "doc_id", "text", "label")}, {SITE},
t AS (SELECT count(*) FILTER (label = 'ham') || ',' || count(*) FILTER (label = 'spam') AS learned FROM {_REPEATS})
SELECT slot, count_ham, count_spam, 0::BIGINT AS archive_ham, 0::BIGINT AS archive_spam, learned FROM site CROSS JOIN t""",
    "background_files": f"WITH {DOCS} SELECT lang, {HASH} & {(1 << SMALL_BITS) - 1} AS slot, count(*) AS cnt FROM feat WHERE lang IS NOT NULL GROUP BY ALL",
    "manifest_files": "WITH l AS (SELECT min(lang) AS first, max(lang) AS last FROM documents) SELECT first AS code, 'changed' AS state FROM l UNION ALL SELECT last, 'unpublished' FROM l",
    "codec_round_trip": f"WITH {TRAIN}, {SITE} SELECT * FROM site",
}
