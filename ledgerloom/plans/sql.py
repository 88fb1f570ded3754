"""The core queries in DuckDB's SQL."""

from ledgerloom.functions import lexicon as _lex

_B = "chr(32) || chr(9) || chr(10) || chr(13)"


def _key(c: str) -> str:
    return f"nullif(lower(trim({c}, {_B})), '')"


_FOUND = f"""
WITH c AS (SELECT {_key("claim_id")} AS k, {_key("doc_id")} AS doc, created_at AS ts FROM claims),
r AS (SELECT {_key("relation_id")} AS k, {_key("claim_a_id")} AS a, {_key("claim_b_id")} AS b, created_at AS ts FROM relations),
c1 AS (SELECT k, doc, ts FROM c WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, doc NULLS FIRST) = 1),
r1 AS (SELECT k, a, b, ts FROM r WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, a NULLS FIRST, b NULLS FIRST) = 1),
refs AS (
  SELECT 'relations' AS ref_table, 'claim_a_id' AS ref_column, k AS row_id, ts, a AS ref, 'claims' AS target FROM r1 WHERE a IS NOT NULL
  UNION ALL SELECT 'relations', 'claim_b_id', k, ts, b, 'claims' FROM r1 WHERE b IS NOT NULL
  UNION ALL SELECT 'claims', 'doc_id', k, ts, doc, 'document_store' FROM c1 WHERE doc IS NOT NULL),
parents AS (
  SELECT 'claims' AS target, k AS ref, min(ts) AS first_at, max(ts) AS last_at FROM c WHERE k IS NOT NULL GROUP BY k
  UNION ALL SELECT 'document_store', {_key("doc_id")} AS k, min(ingested_at), max(ingested_at) FROM document_store WHERE {_key("doc_id")} IS NOT NULL GROUP BY k),
gone AS (SELECT {_key("target_table")} AS target, {_key("target_key")} AS ref, max(deleted_at) AS deleted_at FROM deletion_log GROUP BY 1, 2),
found AS (
  SELECT ref_table, ref_column, row_id, strftime(make_timestamp(CAST(floor(ts * 1000000) AS BIGINT)), '%Y-%m') AS ref_month
  FROM refs LEFT JOIN parents USING (target, ref) LEFT JOIN gone USING (target, ref)
  WHERE first_at IS NULL OR deleted_at > last_at OR first_at > ts)
"""

# The latest delivered row of every key.
_C = f"c AS (SELECT * REPLACE ({_key('claim_id')} AS claim_id) FROM claims WHERE {_key('claim_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_key('claim_id')} ORDER BY created_at DESC) = 1)"
_R = (
    f"r AS (SELECT * REPLACE ({_key('relation_id')} AS relation_id, {_key('kind')} AS kind, {_key('claim_a_id')} AS claim_a_id, {_key('claim_b_id')} AS claim_b_id) FROM relations "
    f"WHERE {_key('relation_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_key('relation_id')} ORDER BY created_at DESC) = 1)"
)
_D = f"d AS (SELECT * REPLACE ({_key('doc_id')} AS doc_id) FROM document_store WHERE {_key('doc_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_key('doc_id')} ORDER BY ingested_at DESC) = 1)"
_W = f"WITH {_C}, {_R}, {_D}"
_X = f"x AS (SELECT r.*, {_key('a.doc_id')} AS a_doc_id, {_key('b.doc_id')} AS b_doc_id FROM r JOIN c a ON a.claim_id = r.claim_a_id JOIN c b ON b.claim_id = r.claim_b_id)"
_CTX = ("period", "unit", "scope", "basis", "geography", "as_of", "denominator", "other")
_PAIR_CTX = ("period", "unit", "scope", "basis", "geography", "denominator", "as_of")


def _low(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _fold(c: str) -> str:
    return f"trim(translate(coalesce({c}, ''), '{_WIDE}–—−' || chr(160) || chr(8239) || chr(8201) || chr(8194) || chr(8195) || chr(12288) || '¹²³', '{_PLAIN}---     123'), {_B})"


def _table(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in pairs.items()) + "}"


_MONEY = _lex.CURRENCY_WORDS | _lex.CURRENCY_SIGNS


def _value(text: str, name: str, source: str, keep: str) -> str:
    """CTEs that end in ``name``: ``keep`` and base, scale, currency, pct, token of a value text."""
    sign = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in _lex.CURRENCY_SIGNS.items()) + " END"
    first = lambda m: f"list_filter(list_transform(words, lambda w: {_table(m)}[w]), lambda v: v IS NOT NULL)[1]"
    return f"""{name}_1 AS (SELECT {keep}, {_fold(text)} AS t FROM {source}),
{name}_2 AS (SELECT *, lower(t) AS low, trim(regexp_extract(t, '([-+]?\\(?\\s*\\d[\\d,\\s]*(?:\\.\\d+)?\\s*\\)?)', 1), {_B}) AS token FROM {name}_1),
{name}_3 AS (SELECT *, list_transform(regexp_extract_all(low, '[a-z₹$€£¥%.]+'), lambda w: regexp_replace(w, '^\\.+|\\.+$', '', 'g')) AS words,
  TRY_CAST(regexp_replace(regexp_replace(token, '^[()+\\-]+|[()+\\-]+$', '', 'g'), '[,\\s]', '', 'g') AS DOUBLE) AS size FROM {name}_2),
{name} AS (SELECT * EXCLUDE (t, low, words, size), CASE WHEN regexp_matches(token, '^[(-]') THEN -abs(size) ELSE size END AS base, coalesce(CAST({first(_lex.MAGNITUDES)} AS DOUBLE), CAST(1 AS DOUBLE)) AS scale,
  coalesce({first(_MONEY)}, {sign}) AS currency, (contains(low, '%') OR contains(low, 'percent') OR contains(low, 'per cent')) AS pct FROM {name}_3)"""


_V = _value("value", "v", "c", "claim_id, value_num, unit, ctx_unit")
_U = (
    _value("coalesce(unit, ctx_unit)", "uu", "v", "claim_id, value_num, unit, ctx_unit, token AS v_token, base AS v_base, scale AS v_scale, currency AS v_currency, pct AS v_pct")
    + ", u AS (SELECT claim_id, value_num, unit, ctx_unit, v_token, v_base, v_scale, coalesce(currency, v_currency) AS currency, CASE WHEN scale = 1.0 THEN v_scale ELSE scale END AS scale, (pct OR v_pct) AS pct FROM uu)"
)
_HALF = """CASE WHEN d <> '' THEN 0.5 * pow(10.0, CASE WHEN contains(d, '.') THEN -length(regexp_extract(d, '\\.(.*)$', 1)) ELSE length(d) - length(regexp_replace(d, '0+$', '')) END) * scale END"""
_DIGITS = "regexp_replace(regexp_replace(token, '^[-+(]+', ''), '[,\\s]', '', 'g')"


def _period(name: str, source: str, keep: str, text: str) -> str:
    full = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{m}') THEN {i} END" for i, m in enumerate(_lex.MONTHS, 1)) + "], lambda z: z IS NOT NULL)"
    short = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '\\b{m[:3]}\\b') THEN {i} END" for i, m in enumerate(_lex.MONTHS, 1)) + "], lambda z: z IS NOT NULL)"
    return f"""{name}_1 AS (SELECT {keep}, lower({_fold(text)}) AS low FROM {source}),
{name}_2 AS (SELECT *, regexp_extract_all(low, '\\b\\d{{4}}\\s*[-/]\\s*\\d{{2,4}}\\b') AS spans, regexp_replace(low, '\\b\\d{{4}}\\s*[-/]\\s*\\d{{2,4}}\\b', ' ', 'g') AS rest FROM {name}_1),
{name} AS (SELECT * EXCLUDE (low, spans, rest),
  list_sort(list_distinct(list_concat(list_concat(
    list_transform(spans, lambda z: CAST(CASE WHEN length(regexp_extract(z, '(\\d+)$', 1)) = 4 THEN regexp_extract(z, '(\\d+)$', 1) ELSE z[1:2] || regexp_extract(z, '(\\d+)$', 1) END AS INT)),
    list_transform(regexp_extract_all(rest, '\\b(?:19|20)\\d{{2}}\\b'), lambda z: CAST(z AS INT))),
    list_transform(regexp_extract_all(low, '\\bfy\\s*[-'']?\\s*(\\d{{2,4}})\\b', 1), lambda z: CASE WHEN length(z) = 4 THEN CAST(z AS INT) WHEN CAST(z AS INT) < 80 THEN CAST(z AS INT) + 2000 ELSE CAST(z AS INT) + 1900 END)))) AS years,
  list_sort(list_distinct(list_transform(regexp_extract_all(low, '\\bq[1-4]\\b|\\b[1-4]q(?:\\d{{2,4}})?\\b'), lambda z: CAST(CASE WHEN z[1:1] = 'q' THEN z[2:2] ELSE z[1:1] END AS INT)))) AS quarters,
  list_sort(list_distinct(list_transform(regexp_extract_all(low, '\\bh([12])\\b', 1), lambda z: CAST(z AS INT)))) AS halves,
  CASE WHEN len({full}) > 0 THEN {full} ELSE {short} END AS months,
  (contains(low, 'fy') OR contains(low, 'fiscal') OR contains(low, 'financial year')) AS fiscal FROM {name}_2)"""


def _join(c: str) -> str:
    return f"coalesce(array_to_string({c}, ';'), '')"


def _words(c: str) -> str:
    """Content words of a property name."""
    stop = ", ".join(f"'{w}'" for w in _lex.PREDICATE_STOPWORDS)
    raw = f"string_split(trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s%]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
    one = (
        "CASE WHEN w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is' THEN w WHEN w LIKE '%ies' AND length(w) >= 6 THEN w[1:length(w) - 3] || 'y' WHEN w LIKE '%sses' AND length(w) >= 7 THEN w[1:length(w) - 4] || 'ss' "
        "WHEN w LIKE '%ses' AND length(w) >= 6 THEN w[1:length(w) - 3] || 's' WHEN w LIKE '%s' AND length(w) >= 4 THEN w[1:length(w) - 1] ELSE w END"
    )
    return f"list_transform(list_filter({raw}, lambda w: length(w) > 1 AND w NOT IN ({stop})), lambda w: {one})"


_SUFFIX = "|".join(sorted({x.rstrip(".") for x in _lex.ORG_SUFFIXES}, key=lambda x: (-len(x), x)))


def _entity(c: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '&', ' and '), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(' ' || {bare}, '(?: (?:{_SUFFIX}))+$', ''))"


_AB = "ab AS (SELECT r.relation_id, a.claim_id AS a_id, b.claim_id AS b_id, " + ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("subject", "predicate", "value", "value_num", "unit", "ctx_period", "ctx_unit", "ctx_scope", "ctx_basis", "ctx_geography", "ctx_denominator", "ctx_as_of")) + " FROM r JOIN c a ON a.claim_id = r.claim_a_id JOIN c b ON b.claim_id = r.claim_b_id)"
_PAIRS = f"{_W}, {_AB}"
_NUM = f"{_W}, {_V}, {_U}, {_AB}, n AS (SELECT *, coalesce(value_num, v_base * CASE WHEN v_scale <> 1.0 THEN v_scale ELSE scale END) AS x, {_HALF} AS half FROM (SELECT *, {_DIGITS.replace('token', 'v_token')} AS d FROM u)), y AS (SELECT ab.relation_id, " + ", ".join(
    f"{s}.{c} AS {s}_{c}" for s in "pq" for c in ("currency", "scale", "pct", "x", "half")
) + " FROM ab JOIN n p ON p.claim_id = a_id JOIN n q ON q.claim_id = b_id)"
_PP = f"{_PAIRS}, {_period('pa', 'ab', 'relation_id', 'a_ctx_period')}, {_period('pb', 'ab', 'relation_id', 'b_ctx_period')}, pp AS (SELECT relation_id, " + ", ".join(f"{s}.{c} AS {s}_{c}" for s in ("pa", "pb") for c in ("years", "quarters", "halves", "months")) + ", len(pa.years) + len(pa.quarters) + len(pa.halves) + len(pa.months) > 0 AS pa_stated, len(pb.years) + len(pb.quarters) + len(pb.halves) + len(pb.months) > 0 AS pb_stated FROM pa JOIN pb USING (relation_id))"
_ANT = " OR ".join(
    f"(len(list_intersect(wa, {g!r})) > 0 AND len(list_intersect(wb, {g!r})) > 0 AND len(list_intersect(list_intersect(wa, {g!r}), list_intersect(wb, {g!r}))) = 0)" for g in _lex.ANTONYM_GROUPS
)
_WAB = f"{_PAIRS}, w AS (SELECT relation_id, {_words('a_predicate')} AS wa, {_words('b_predicate')} AS wb FROM ab)"
_REVIEW = "CASE WHEN regexp_matches(lower(reason), 'evidence|located|numbers') THEN 'grounding' WHEN regexp_matches(lower(reason), 'page|context|period') THEN 'context' WHEN regexp_matches(lower(reason), 'predicate|vocab|unit') THEN 'vocab' ELSE 'other' END"
# Blocking with a name's key as its entity.
_BLOCK = f"""{_W}, {_V}, {_U}, blk AS (
  SELECT c.claim_id AS id, coalesce(c.doc_id, '') AS doc, {_entity('c.subject')} AS cluster, CASE WHEN u.pct THEN 'rate' WHEN c.value_num IS NULL AND u.v_base IS NULL THEN 'text' ELSE 'quantity' END AS kind,
    list_sort(list_distinct({_words('c.predicate')})) AS words, c.created_at FROM c JOIN u USING (claim_id) WHERE NOT coalesce(c.quarantined, false)),
tok AS (SELECT id, doc, cluster, kind, len(words) AS n, unnest(words) AS t, created_at FROM blk WHERE cluster <> ''),
prs AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS inter, any_value(a.created_at) AS at_a FROM tok a JOIN tok b ON a.cluster = b.cluster AND a.kind = b.kind AND a.t = b.t AND a.doc <> b.doc GROUP BY a.id, b.id, a.n, b.n)"""
_TOPK = "rnk AS (SELECT a, b, inter / (na + nb - inter) AS sim FROM prs {where} QUALIFY row_number() OVER (PARTITION BY a ORDER BY inter / (na + nb - inter) DESC, b DESC) <= 15) SELECT DISTINCT least(a, b) AS a_id, greatest(a, b) AS b_id, round(sim, 4) AS similarity FROM rnk"
_LINES = "ln AS (SELECT doc_id AS page_no, source, i - 1 AS line_no, l[i] AS text, list_sum(list_transform(l[1:i - 1], lambda z: length(z) + 1)) AS before FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL))"
_SCORE = """SELECT claim_id, CAST(greatest(0.0, least(1.0, CAST(round(CAST(coalesce(grounding_score, 0.0) AS DECIMAL(18,8)) * CASE WHEN value_in_span = false THEN CAST(0.5 AS DECIMAL(2,1)) ELSE CAST(1.0 AS DECIMAL(2,1)) END, 4) AS DOUBLE))) AS DOUBLE) AS grounding_conf,
 (NOT (coalesce(grounded, false) AND coalesce(grounding_score, 0.0) >= 0.8) OR coalesce(NOT value_in_span, false)) AS is_quarantined, round(coalesce(extraction_confidence, 0.0), 4) AS e FROM c"""

ORACLE = {
    "p5_found": f"{_FOUND} SELECT * FROM found",
    "p5_report": f"{_FOUND} SELECT ref_table, ref_column, ref_month, count(*) AS orphans FROM found GROUP BY ALL",
    "claims_latest": f"{_W} SELECT claim_id, doc_id, value, created_at FROM c",
    "documents_latest": f"{_W} SELECT doc_id, filename, status, ingested_at FROM d",
    "relations_latest": f"{_W} SELECT relation_id, kind, created_at FROM r",
    "documents_completed": f"{_W} SELECT doc_id, pages_read FROM d WHERE lower(trim(status)) = 'extracted'",
    "delete_document_cascade": f"""{_W}, gone AS (SELECT DISTINCT {_key('target_key')} AS k FROM deletion_log WHERE {_key('target_table')} = 'document_store'),
dead AS (SELECT claim_id FROM c WHERE {_key('doc_id')} IN (SELECT k FROM gone WHERE k IS NOT NULL))
SELECT (SELECT count(*) FROM c WHERE claim_id NOT IN (SELECT claim_id FROM dead)) AS claims_left,
 (SELECT count(*) FROM r WHERE coalesce(claim_a_id, '') NOT IN (SELECT claim_id FROM dead) AND coalesce(claim_b_id, '') NOT IN (SELECT claim_id FROM dead)) AS relations_left""",
    "claims_by_ids": f"{_W} SELECT claim_id, subject FROM c WHERE claim_id IN (SELECT {_key('target_key')} FROM deletion_log WHERE {_key('target_table')} = 'claims')",
    "claims_filtered": f"{_W} SELECT claim_id, final_confidence FROM c WHERE needs_review AND NOT quarantined AND origin = 'table'",
    "claims_search": f"{_W} SELECT claim_id, predicate FROM c WHERE subject ILIKE '%inflation%' OR predicate ILIKE '%inflation%' OR value ILIKE '%inflation%'",
    "claims_top_confidence": f"{_W} SELECT claim_id, final_confidence FROM c ORDER BY final_confidence DESC NULLS LAST, claim_id LIMIT 200 OFFSET 50",
    "claims_comparable": f"{_W} SELECT origin, count(*) AS claims FROM c WHERE NOT coalesce(quarantined, false) GROUP BY 1",
    "quarantine_split": f"{_W} SELECT quarantined, needs_review, count(*) AS claims FROM c GROUP BY 1, 2",
    "claim_counts": f"{_W} SELECT count(*) AS claims, count(*) FILTER (needs_review) AS review, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (origin = 'table') AS from_tables FROM c",
    "claims_by_origin": f"{_W} SELECT origin, modality, count(*) AS claims FROM c GROUP BY 1, 2",
    "document_claim_counts": f"{_W} SELECT d.doc_id, coalesce(n, 0) AS claim_count, ingested_at FROM d LEFT JOIN (SELECT {_key('doc_id')} AS doc_id, count(*) AS n FROM c GROUP BY 1) q ON q.doc_id = d.doc_id",
    "relations_cross_document": f"{_W}, {_X} SELECT relation_id, kind, a_doc_id, b_doc_id FROM x WHERE kind <> 'unrelated' AND a_doc_id <> b_doc_id",
    "relations_top": f"{_W}, {_X} SELECT relation_id, confidence FROM x WHERE kind = 'contradiction' AND a_doc_id <> b_doc_id ORDER BY confidence DESC NULLS LAST, similarity DESC NULLS LAST, relation_id LIMIT 100",
    "relations_of_document": f"{_W}, {_X} SELECT relation_id, kind FROM x WHERE kind <> 'unrelated' AND (a_doc_id = '3be47e1b80e60f65' OR b_doc_id = '3be47e1b80e60f65')",
    "relations_enriched": f"{_W} SELECT relation_id, a.subject AS a_subject, b.value AS b_value FROM r LEFT JOIN c a ON a.claim_id = claim_a_id LEFT JOIN c b ON b.claim_id = claim_b_id",
    "relations_by_kind": f"{_W}, {_X} SELECT kind, count(*) AS relations FROM x WHERE kind <> 'unrelated' AND a_doc_id <> b_doc_id GROUP BY 1",
    "relations_missing_side": f"{_W} SELECT relation_id, 'a' AS side FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.claim_id = r.claim_a_id) UNION ALL SELECT relation_id, 'b' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.claim_id = r.claim_b_id)",
    "stats_dashboard": f"""{_W} SELECT (SELECT count(*) FROM d) AS documents, count(*) AS claims, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (quarantined) AS quarantined,
 count(*) FILTER (origin = 'table') AS from_tables, count(*) FILTER (grounded) AS grounded, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM r WHERE kind = 'contradiction') AS contradictions,
 (SELECT count(*) FROM r WHERE decided_by = 'llm') AS by_model FROM c""",
    "grounding_profile": f"{_W} SELECT count(*) FILTER (grounding_score = 1) AS exact, count(*) FILTER (grounding_score > 0 AND grounding_score < 1) AS near, count(*) FILTER (coalesce(grounding_score, 0) = 0) AS not_located FROM c",
    "decided_by_share": f"{_W} SELECT count(*) AS relations, count(*) FILTER (decided_by = 'llm') AS by_model, round(count(*) FILTER (decided_by = 'llm') * 100.0 / count(*), 4) AS percent FROM r",
    "dedupe_best_confidence": f"{_W} SELECT claim_id, final_confidence FROM c QUALIFY row_number() OVER (PARTITION BY {', '.join(_low(x) for x in ('doc_id', 'subject', 'predicate', 'value', 'ctx_period', 'ctx_scope', 'unit'))} ORDER BY final_confidence DESC NULLS LAST, claim_id) = 1",
    "review_buckets": f"{_W} SELECT {_REVIEW} AS bucket, count(*) AS reasons FROM (SELECT unnest(review_reasons) AS reason FROM c) GROUP BY 1",
    "evidence_choice": f"{_W} SELECT claim_id, CASE WHEN length(matched_text) >= 12 OR coalesce(span_text, '') = '' THEN matched_text ELSE span_text END AS evidence, coalesce(grounding_page, span_page) AS page FROM c",
    "stated_context": f"{_W} " + " UNION ALL ".join(f"SELECT claim_id, '{x}' AS field, ctx_{x} AS stated FROM c WHERE ctx_{x} <> ''" for x in _CTX),
    "context_diff_view": f"{_PAIRS} " + " UNION ALL ".join(f"SELECT relation_id, '{x}' AS field, coalesce(a_ctx_{x}, '') <> coalesce(b_ctx_{x}, '') AS differs FROM ab WHERE coalesce(a_ctx_{x}, '') <> '' OR coalesce(b_ctx_{x}, '') <> ''" for x in _PAIR_CTX),
    "export_sample_relations": f"{_W} SELECT relation_id, kind FROM r WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY confidence DESC NULLS LAST, relation_id) <= 40",
    "best_two_per_kind": f"{_W} SELECT kind, relation_id, confidence FROM r WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY confidence DESC NULLS LAST, relation_id) <= 2",
    "worst_flagged": f"{_W} SELECT claim_id, final_confidence FROM c WHERE needs_review ORDER BY final_confidence ASC NULLS LAST, claim_id LIMIT 20",
    "nested_as_json": f"{_W} SELECT claim_id, len(review_reasons) AS reasons FROM c",
    "parse_value_number": f"{_W}, {_V} SELECT claim_id, base FROM v",
    "parse_value_parts": f"{_W}, {_V} SELECT claim_id, scale, currency, pct AS percent FROM v",
    "unit_signature": f"{_W}, {_V}, {_U} SELECT claim_id, currency, scale, pct AS percent FROM u",
    "unit_labels": f"{_W}, {_V} SELECT CASE WHEN pct THEN 'percent' ELSE nullif(concat_ws(' ', currency, CASE " + " ".join(f"WHEN scale = {k!r} THEN '{v}'" for k, v in _lex.SCALE_NAMES.items()) + " END), '') END AS label, count(*) AS claims FROM v GROUP BY 1",
    "precision_half_unit": f"{_W}, {_V} SELECT claim_id, {_HALF} AS half FROM (SELECT *, {_DIGITS} AS d FROM v)",
    "measure_kinds": f"{_W}, {_V}, {_U} SELECT CASE WHEN pct THEN 'rate' WHEN value_num IS NULL AND v_base IS NULL THEN 'text' ELSE 'quantity' END AS kind, count(*) AS claims FROM u GROUP BY 1",
    "numbers_in_text": f"{_W} SELECT claim_id, " + _join("list_filter(list_transform(list_transform(regexp_extract_all(coalesce(value, ''), '\\d[\\d,. ]*'), lambda n: regexp_replace(regexp_replace(n, '[, ]', '', 'g'), '\\.+$', '')), lambda n: CASE WHEN contains(n, '.') THEN regexp_replace(regexp_replace(n, '0+$', ''), '\\.$', '') ELSE n END), lambda n: n <> '')") + " AS numbers FROM c",
    "period_signature": f"{_W}, {_period('p', 'c', 'claim_id', 'ctx_period')} SELECT claim_id, {_join('years')} AS years, {_join('quarters')} AS quarters, {_join('halves')} AS halves, {_join('months')} AS months, fiscal FROM p",
    "period_compare_pairs": f"""{_PP} SELECT relation_id, CASE WHEN NOT pa_stated OR NOT pb_stated THEN 'unknown' WHEN pa_quarters <> pb_quarters OR pa_halves <> pb_halves THEN 'different'
 WHEN len(pa_years) > 0 AND len(pb_years) > 0 AND NOT list_has_any(pa_years, pb_years) THEN 'different' WHEN pa_months <> pb_months THEN 'different' WHEN pa_years = pb_years THEN 'same' ELSE 'unknown' END AS verdict FROM pp""",
    "period_precedes": f"""{_PP}, o AS (SELECT *, list_max(pa_years) AS ya, list_max(pb_years) AS yb, coalesce(list_max(pa_quarters), 0) AS qa, coalesce(list_max(pb_quarters), 0) AS qb, coalesce(list_max(pa_months), 0) AS ma, coalesce(list_max(pb_months), 0) AS mb FROM pp)
SELECT CAST(CASE WHEN NOT pa_stated OR NOT pb_stated THEN 0 WHEN ya < yb THEN -1 WHEN ya > yb THEN 1 WHEN ya IS NOT DISTINCT FROM yb AND qa <> qb THEN sign(qa - qb) WHEN ya IS NOT DISTINCT FROM yb AND ma <> mb THEN sign(ma - mb) ELSE 0 END AS INT) AS ordering, count(*) AS pairs FROM o GROUP BY 1""",
    "entity_normalize": f"{_W} SELECT {_entity('subject')} AS entity, count(*) AS claims FROM c GROUP BY 1",
    "entity_containment": f"{_PAIRS}, e AS (SELECT relation_id, string_split({_entity('a_subject')}, ' ') AS a, string_split({_entity('b_subject')}, ' ') AS b FROM ab) SELECT relation_id, (list_has_all(b, a) OR list_has_all(a, b)) AS contained FROM e",
    "acronym_of": "SELECT entity_id, coalesce(array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(entity_name), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in _lex.ACRONYM_SKIP) + ")), lambda w: w[1:1]), ''), '') AS acronym FROM entity_register",
    "predicate_tokens": f"{_W} SELECT coalesce(array_to_string({_words('predicate')}, ' '), '') AS words, count(*) AS claims FROM c GROUP BY 1",
    "predicate_jaccard": f"{_WAB} SELECT relation_id, coalesce(round(len(list_intersect(list_distinct(wa), list_distinct(wb))) / nullif(len(list_distinct(list_concat(wa, wb))), 0), 4), 0.0) AS jaccard FROM w",
    "antonym_conflict": f"{_WAB} SELECT relation_id, ({_ANT}) AS opposed FROM w",
    "more_specific": f"{_WAB} SELECT CASE WHEN len(list_distinct(wb)) > 0 AND list_has_all(wa, wb) AND NOT list_has_all(wb, wa) THEN 1 WHEN len(list_distinct(wa)) > 0 AND list_has_all(wb, wa) AND NOT list_has_all(wa, wb) THEN -1 ELSE 0 END AS direction, count(*) AS pairs FROM w GROUP BY 1",
    "candidate_pairs_topk": f"{_BLOCK}, {_TOPK.format(where='')}",
    "candidate_pairs_incremental": f"{_BLOCK}, {_TOPK.format(where='WHERE at_a >= 1748736000')}",
    "pair_ids_sha": f"{_W} SELECT relation_id, sha256(least(claim_a_id, claim_b_id) || '|' || greatest(claim_a_id, claim_b_id))[1:20] AS pair_id FROM r WHERE claim_a_id IS NOT NULL AND claim_b_id IS NOT NULL",
    "unit_check": f"{_NUM} SELECT relation_id, CASE WHEN coalesce(p_currency <> q_currency, false) OR p_pct <> q_pct THEN 'incomparable' WHEN (p_currency IS NOT NULL OR p_scale <> 1.0) <> (q_currency IS NOT NULL OR q_scale <> 1.0) THEN 'unknown' ELSE 'same' END AS verdict FROM y",
    "value_check": f"""{_NUM} SELECT relation_id, CASE WHEN p_x IS NULL OR q_x IS NULL THEN 'incomparable'
 WHEN p_pct AND q_pct THEN CASE WHEN abs(p_x - q_x) <= greatest(CASE WHEN p_half IS NULL OR q_half IS NULL THEN 0.0 ELSE greatest(p_half, q_half) END, 0.05) THEN 'equivalent' ELSE 'differ' END
 WHEN p_x = q_x THEN 'equal' WHEN coalesce(abs(p_x - q_x) <= CASE WHEN p_half IS NULL OR q_half IS NULL THEN NULL ELSE greatest(p_half, q_half) END, false) OR abs(p_x - q_x) / greatest(abs(p_x), abs(q_x)) <= 0.02 THEN 'equivalent' ELSE 'differ' END AS verdict
 FROM y WHERE p_x IS NOT NULL OR q_x IS NOT NULL""",
    "score_claims": f"{_W}, s AS ({_SCORE}) SELECT claim_id, grounding_conf, CAST(round(CAST(e AS DECIMAL(10,4)) * CAST(grounding_conf AS DECIMAL(10,4)), 4) AS DOUBLE) AS combined, is_quarantined, (is_quarantined OR round(CAST(e AS DECIMAL(10,4)) * CAST(grounding_conf AS DECIMAL(10,4)), 4) < 0.6) AS is_review FROM s",
    "line_offsets": f"WITH {_LINES} SELECT CAST(page_no AS BIGINT) AS page_no, CAST(line_no AS INT) AS line_no, CAST(coalesce(before, 0) AS BIGINT) AS char_start, CAST(coalesce(before, 0) + length(text) AS BIGINT) AS char_end FROM ln",
    "furniture_lines": f"""WITH {_LINES}, t AS (SELECT DISTINCT source AS doc_id, page_no, trim(text, {_B}) AS text FROM ln), n AS (SELECT source AS doc_id, count(DISTINCT doc_id) AS pages FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT t.doc_id, text, count(*) AS on_pages FROM t JOIN n USING (doc_id) WHERE length(text) > 3 GROUP BY t.doc_id, text, pages HAVING count(*) >= greatest(3, floor(pages * 0.02))""",
    "value_mentions": "SELECT CAST(doc_id AS BIGINT) AS page_no, CAST(len(regexp_extract_all(text, '(?i)(?:(?:[₹$€£¥]|\\b(?:Rs\\.?|INR|USD|US\\$|EUR|GBP|JPY)\\b)\\s*)?\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?(?:\\s*(?:hundred|thousand|lakhs?|lacs?|million|billion|trillion|crores?|mn|bn|tn|cr|k)\\b)?(?:\\s*(?:%|per\\s?cent(?:age)?|percent))?')) AS INT) AS mentions FROM documents WHERE text IS NOT NULL",
    "headings_before": f"""WITH {_LINES}, h AS (SELECT page_no, last_value(CASE WHEN upper(text) = text AND regexp_matches(text, '[A-Z]{{4}}') THEN text END IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY line_no) AS heading FROM ln)
SELECT CAST(page_no AS BIGINT) AS page_no, count(*) AS lines, count(DISTINCT heading) AS headings FROM h WHERE heading IS NOT NULL GROUP BY 1""",
}

# The corpus as files and pages, and reports over it.
_P = f"""pg AS (SELECT coalesce({_key('source_doc_id')}, '#' || CAST(doc_id AS VARCHAR)) AS doc_id, coalesce(page_no, 1) AS page_no, string_agg(text, chr(10) ORDER BY documents.doc_id) AS raw
 FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)"""
_OPEN = ", ".join(f"'{r[0]}'" for r in _lex.RULES if r[3])
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_KINDS = ("corroboration", "contradiction", "reconciled", "partial_cover", "component_of_total", "supersedes", "underspecified")
_FLAGGED = "(coalesce(needs_review, false) OR coalesce(quarantined, false))"


def _norm(c: str) -> str:
    """Text as evidence is compared."""
    plain = f"replace(translate({_fold(c)}, '‘’‚“”„', '\"\"\"'), chr(173), '')"
    return f"lower(trim(regexp_replace(regexp_replace({plain}, '-\\s*\\n\\s*(\\p{{L}})', '\\1', 'g'), '\\s+', ' ', 'g')))"


ORACLE |= {
    "sentence_counts": f"""SELECT * FROM (SELECT CAST(doc_id AS BIGINT) AS page_no, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?;])[\\s\\p{{Zs}}]+([A-Z("''‘“₹$€£])', '\\1' || chr(1) || '\\2', 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda z: regexp_replace(z, '[\\s\\p{{Zs}}]', '', 'g') <> '')) AS INT) AS sentences FROM documents WHERE text IS NOT NULL) WHERE sentences > 0""",
    "chunked_pages": f"""WITH RECURSIVE {_P}, b AS (SELECT doc_id, page_no, length(trim(raw, {_BLANKS})) + length(CAST(page_no AS VARCHAR)) + 14 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM pg WHERE trim(raw, {_BLANKS}) <> ''),
 w(doc_id, page_no, n, i, size, chunk) AS (SELECT doc_id, page_no, n, i, n, 0 FROM b WHERE i = 1
  UNION ALL SELECT b.doc_id, b.page_no, b.n, b.i, CASE WHEN w.size + b.n <= 4000 THEN w.size + b.n ELSE b.n END, CASE WHEN w.size + b.n <= 4000 THEN w.chunk ELSE w.chunk + 1 END FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
 SELECT doc_id, CAST(chunk AS INT) AS chunk, min(page_no) AS first_page, max(page_no) AS last_page, CAST(sum(n) AS INT) AS chars FROM w GROUP BY 1, 2""",
    "gap_pages": f"""{_W}, {_P}, o AS (SELECT doc_id, page_no FROM pg WHERE length(raw) - length(regexp_replace(raw, '\\d', '', 'g')) > 40 AND NOT EXISTS (SELECT 1 FROM c WHERE {_key('c.doc_id')} = pg.doc_id AND c.span_page = pg.page_no))
 SELECT doc_id, page_no FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_no) <= 15""",
    "ingest_report": f"""{_W}, {_P}, s AS (SELECT {_key('doc_id')} AS doc_id, count(*) AS stored, count(*) FILTER (NOT coalesce(quarantined, false)) AS grounded, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (needs_review) AS needs_review,
 count(*) FILTER (origin = 'table') AS from_tables, count(*) FILTER (origin = 'llm') AS by_model FROM c GROUP BY 1)
 SELECT p.doc_id, pages_read, coalesce(stored, 0) AS stored, coalesce(grounded, 0) AS grounded, coalesce(quarantined, 0) AS quarantined, coalesce(needs_review, 0) AS needs_review, coalesce(from_tables, 0) AS from_tables, coalesce(by_model, 0) AS by_model
 FROM (SELECT doc_id, count(*) AS pages_read FROM pg GROUP BY 1) p LEFT JOIN s USING (doc_id)""",
    "relate_report": f"{_W} SELECT kind, count(*) AS relations, count(*) FILTER (decided_by = 'llm') AS by_model, count(*) FILTER (rule_id IN ({_OPEN})) AS open, round(count(*) FILTER (decided_by = 'llm') * 100.0 / (SELECT count(*) FROM r WHERE kind IS NOT NULL), 2) AS percent_by_model FROM r WHERE kind IS NOT NULL GROUP BY 1",
    "mode_report": f"""{_W} SELECT 'stored' AS mode, claims, grounded, quarantined, table_claims, model_claims, {', '.join(_KINDS)}, by_model, round(by_model * 100.0 / greatest(1, claims), 2) AS percent_by_model
 FROM (SELECT count(*) AS claims, count(*) FILTER (NOT coalesce(quarantined, false)) AS grounded, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (origin = 'table') AS table_claims, count(*) FILTER (origin = 'llm') AS model_claims FROM c),
 (SELECT {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS)}, count(*) FILTER (decided_by = 'llm') AS by_model FROM r)""",
    "adjudication_budget": f"{_W} SELECT relation_id, row_number() OVER (ORDER BY match_confidence DESC NULLS LAST, relation_id) <= 200 AS chosen FROM r WHERE rule_id IN ({_OPEN})",
    "judged_relations": f"""{_W}, o AS (SELECT relation_id FROM r WHERE rule_id IN ({_OPEN}) ORDER BY match_confidence DESC NULLS LAST, relation_id LIMIT 200)
 SELECT relation_id, CASE WHEN o.relation_id IS NULL THEN kind ELSE 'reconciled' END AS kind, CASE WHEN o.relation_id IS NULL THEN decided_by ELSE 'llm' END AS decided_by, CASE WHEN o.relation_id IS NULL THEN relationship_confidence ELSE 0.75 END AS relationship_confidence FROM r LEFT JOIN o USING (relation_id)""",
    "claim_detail": f"{_W}, f AS (SELECT min(claim_id) AS id FROM c) SELECT claim_id, subject, CAST((SELECT count(*) FROM r, f WHERE claim_a_id = id OR claim_b_id = id) AS INT) AS relations FROM c WHERE claim_id = (SELECT id FROM f)",
    "claims_of_document": f"{_W} SELECT claim_id, final_confidence FROM c WHERE {_key('doc_id')} = (SELECT min({_key('doc_id')}) FROM c)",
    "embedding_scan": f"{_W} SELECT claim_id, round(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE))), 3) AS total FROM c WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: z <> 0)) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR isnan(z))) = 0",
    "embedded_texts": f"{_W} SELECT trim(coalesce(subject, '')) || ' | ' || trim(coalesce(predicate, '')) AS text, count(*) AS claims FROM c GROUP BY 1",
    "evidence_boxes": f"{_W} SELECT {_key('doc_id')} AS doc_id, span_page, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM c WHERE bbox IS NOT NULL GROUP BY 1, 2",
    "export_claims_sample": f"""{_W}, g AS (SELECT *, CASE WHEN {_FLAGGED} THEN 'flagged' WHEN origin = 'table' THEN 'table' ELSE 'prose' END AS grp FROM c)
 SELECT claim_id, origin, final_confidence FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN {_FLAGGED} THEN final_confidence END ASC NULLS LAST, final_confidence DESC NULLS LAST, claim_id) <= CASE grp WHEN 'table' THEN 50 ELSE 25 END""",
    "arrivals_by_day": "SELECT strftime(make_timestamp(CAST(floor(created_at / 86400) * 86400000000 AS BIGINT)), '%Y-%m-%d') AS day, origin, count(*) AS claims FROM claims WHERE created_at IS NOT NULL GROUP BY 1, 2",
    "stream_first_deliveries": f"SELECT claim_id, any_value(origin) AS origin FROM (SELECT {_key('claim_id')} AS claim_id, origin FROM claims WHERE created_at IS NOT NULL) WHERE claim_id IS NOT NULL GROUP BY 1",
    "grounded_exactly": f"""{_W}, {_P}, n AS (SELECT doc_id, page_no, {_norm('raw')} AS norm FROM pg WHERE {_norm('raw')} <> ''),
 q AS (SELECT claim_id, {_key('doc_id')} AS doc_id, coalesce(span_page, 1) AS p, coalesce(origin, 'sentence') AS origin, {_norm('span_text')} AS q, {_norm('value')} AS v, {_norm("string_split(coalesce(span_text, ''), '|')[1]")} AS label, length(trim(coalesce(span_text, ''))) AS len FROM c),
 hits AS (SELECT claim_id, page_no, CASE WHEN page_no = p THEN 0 WHEN abs(page_no - p) <= 3 THEN 2 * abs(page_no - p) - CASE WHEN page_no < p THEN 1 ELSE 0 END ELSE 7 + page_no END AS rank FROM q JOIN n USING (doc_id) WHERE origin <> 'table' AND len >= 8 AND q <> '' AND contains(norm, q))
 SELECT claim_id, page_no AS page, CAST(1.0 AS DOUBLE) AS score, 'exact match' AS note FROM hits QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY rank) = 1
 UNION ALL SELECT claim_id, NULL, CAST(0.0 AS DOUBLE), 'evidence too short' FROM q WHERE origin <> 'table' AND len < 8
 UNION ALL SELECT claim_id, page_no, CAST(CASE WHEN v <> '' AND contains(norm, v) THEN CASE WHEN label <> '' AND contains(norm, label) THEN 1.0 ELSE 0.7 END ELSE 0.0 END AS DOUBLE),
  CASE WHEN norm IS NULL THEN 'page not found' WHEN v <> '' AND contains(norm, v) THEN CASE WHEN label <> '' AND contains(norm, label) THEN 'row label and value on the page' ELSE 'value on the page, row label not' END ELSE 'value not on the page' END
  FROM q LEFT JOIN n ON n.doc_id = q.doc_id AND n.page_no = q.p WHERE origin = 'table'""",
}

# Line items as tables, one per ship month, with their score.
_G = """sums AS (SELECT CAST(month(l_shipdate) AS INT) AS grid_id, l_returnflag AS f, year(l_shipdate) AS y, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY ALL),
ys AS (SELECT DISTINCT grid_id, y FROM sums), fs AS (SELECT DISTINCT grid_id, f FROM sums),
cell AS (SELECT grid_id, f, y, coalesce(CAST(q AS VARCHAR), '') AS v FROM ys JOIN fs USING (grid_id) LEFT JOIN sums USING (grid_id, f, y)),
rws AS (SELECT grid_id, f, ['flag ' || f || ' quantity'] || list(v ORDER BY y) AS r FROM cell GROUP BY 1, 2),
hds AS (SELECT grid_id, ['(million)'] || list('FY' || y ORDER BY y) AS h FROM ys GROUP BY 1),
gs AS (SELECT grid_id, h, list(r ORDER BY f) AS rows FROM rws JOIN hds USING (grid_id) GROUP BY 1, 2),
fl AS (SELECT grid_id, h, rows, h || flatten(rows) AS flat FROM gs),
part AS (SELECT grid_id, h, rows, flat, len(list_filter(flat, lambda c: c <> '')) / len(flat) AS filled, len(list_filter(flat, lambda c: regexp_matches(c, '\\d'))) / len(flat) AS numeric,
  len(list_filter(flat, lambda c: length(c) > 90 OR len(regexp_extract_all(c, '[-+(]?\\d[\\d,]*(?:\\.\\d+)?\\)?')) > 2)) / len(flat) AS crowded, len(list_filter(h, lambda c: c <> '' AND NOT regexp_matches(c, '\\d'))) / len(h) AS head,
  list_avg(list_transform(list_filter(flat, lambda c: c <> ''), lambda c: length(c))) AS mean FROM fl),
sc AS (SELECT *, CASE WHEN len(h) < 2 OR numeric < 0.10 OR mean > 45 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.30 * filled + 0.25 * numeric + 0.20 * head + 0.25 * 1.0 - 1.20 * crowded)) END AS score FROM part)"""
ORACLE |= {
    "grid_scores": f"WITH {_G} SELECT grid_id, round(CAST(score AS DOUBLE), 6) AS score FROM sc",
    "grid_claims": f"""WITH {_G}, num AS (SELECT grid_id, f, y, v, row_number() OVER (PARTITION BY grid_id, y ORDER BY f) - 1 AS i, row_number() OVER (PARTITION BY grid_id, f ORDER BY y) AS j FROM cell)
 SELECT grid_id, lower('flag ' || f || ' quantity') AS predicate, v AS value, CAST(v AS DOUBLE) * 1e6 AS value_num, 'million' AS unit, 'FY' || y AS ctx_period, CAST(NULL AS VARCHAR) AS ctx_scope,
  round(least(0.95, CAST((0.72 + 0.10 + 0.06) AS DOUBLE) * least(1.0, 0.6 + CAST(score AS DOUBLE))), 3) AS extraction_confidence, CAST(i AS INT) AS row, CAST(j AS INT) AS col FROM num JOIN sc USING (grid_id) WHERE v <> '' AND score >= 0.34""",
    "word_grids": f"WITH {_G} SELECT grid_id, CAST(len(rows) + 1 AS INT) AS rows, CAST(len(h) AS INT) AS cols FROM sc",
    "selected_tables": f"WITH {_G} SELECT grid_id, 1 AS header_rows, CAST(len(h) AS INT) AS columns, CAST(len(rows) AS INT) AS rows FROM sc",
}
ORACLE |= {
    "end_matter_pages": """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS pages FROM orders),
 l AS (SELECT * FROM n WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey DESC) = 1)
 SELECT doc_id, o_orderkey AS end_page, CAST(length('Order ' || o_orderkey) + 1 AS BIGINT) AS end_char FROM l WHERE i >= floor(pages * 0.55)""",
    "marked_headings": """WITH t AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS DOUBLE) AS size, l_returnflag = 'R' AS bold, 'shipped on the ' || strftime(l_shipdate, '%d') || ' ' || l_linestatus AS text FROM lineitem),
 m AS (SELECT doc_id, list_sort(list(size))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM t GROUP BY 1)
 SELECT doc_id, count(*) FILTER (length(text) <= 120 AND length(text) - length(regexp_replace(text, '\\d', '', 'g')) <= 0.4 * length(text) AND (size >= 1.12 * median OR (bold AND size >= median))) AS headings, count(*) AS lines FROM t JOIN m USING (doc_id) GROUP BY 1""",
}
