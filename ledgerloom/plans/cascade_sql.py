"""The gates and the whole chain of verdicts in DuckDB's SQL, ratios of longest common subsequences included.

A row of the usual table for a common subsequence is the running maximum of what each column offers, so it needs no
sequential step: one list expression a character, and a recursion over the characters of the other string. All string
pairs that any step needs are gathered first and compared once.
"""

from __future__ import annotations

from ledgerloom.functions import lexicon as _lex
from ledgerloom.plans.sql import _ANT, _BLOCK, _DIGITS, _HALF, _TOPK, _V, _W, ORACLE, _entity, _period, _value, _words

_FIELDS = ("scope", "basis", "geography", "denominator", "as_of")
_RAW = ["subject", "predicate", "value", "value_num", "unit", "ctx_unit", "ctx_period", "modality", "origin", "final_confidence", *[f"ctx_{f}" for f in _FIELDS]]


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _bare(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _voice(c: str) -> str:
    """The acronym of a name of two words or more."""
    return f"CASE WHEN contains({c}, ' ') THEN array_to_string(list_transform(list_filter(string_split({_bare(c)}, ' '), lambda z: z <> '' AND z NOT IN ({_in(_lex.ACRONYM_SKIP)})), lambda z: z[1:1]), '') END"


_CLAIMS = f"""{_W}, {_V},
{_value("coalesce(nullif(unit, ''), ctx_unit)", 'cu', 'v', "claim_id, value_num, coalesce(nullif(unit, ''), ctx_unit) AS raw, token AS v_token, base AS v_base, scale AS v_scale, currency AS v_currency, pct AS v_pct")},
us AS (SELECT claim_id, value_num, raw, v_token, v_base, v_scale, coalesce(currency, v_currency) AS currency, CASE WHEN scale = 1.0 THEN v_scale ELSE scale END AS scale, (pct OR v_pct) AS pct FROM cu),
nu AS (SELECT claim_id, raw, currency, scale, pct, coalesce(value_num, v_base * CASE WHEN v_scale <> 1.0 THEN v_scale ELSE scale END) AS x, {_HALF} AS half FROM (SELECT *, {_DIGITS.replace('token', 'v_token')} AS d FROM us)),
{_period('pd', 'c', 'claim_id', 'ctx_period')},
nm AS (SELECT claim_id, {_entity('subject')} AS k, {_bare('subject')} AS f, {_words('predicate')} AS w FROM c),
cl AS (SELECT claim_id, {', '.join('c.' + x for x in _RAW)}, raw, currency, scale, pct, x, half, years, quarters, halves, months, len(years) + len(quarters) + len(halves) + len(months) > 0 AS stated, k, {_voice('k')} AS ik, {_voice('f')} AS jf, w
  FROM c JOIN nu USING (claim_id) JOIN pd USING (claim_id) JOIN nm USING (claim_id))"""
_SIDE = [*_RAW, "raw", "currency", "scale", "pct", "x", "half", "years", "quarters", "halves", "months", "stated", "k", "ik", "jf", "w"]


def _low(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


def _sets(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda z: z <> '')))"


_TEXTS = [("value", "value"), *[(f, f"ctx_{f}") for f in _FIELDS]]
_PAIRS = f"""{_CLAIMS},
ab AS (SELECT r.relation_id, a.claim_id AS a_id, b.claim_id AS b_id, {', '.join(f'{s}.{x} AS {s}_{x}' for s in 'ab' for x in _SIDE)} FROM r JOIN cl a ON a.claim_id = r.claim_a_id JOIN cl b ON b.claim_id = r.claim_b_id),
ent AS (SELECT DISTINCT a_k AS p, b_k AS q, a_ik AS pi, a_jf AS pj, b_ik AS qi, b_jf AS qj, list_distinct(string_split(a_k, ' ')) AS ps, list_distinct(string_split(b_k, ' ')) AS qs FROM ab),
ent1 AS (SELECT *, len(list_intersect(ps, qs)) AS met, array_to_string(list_sort(string_split(p, ' ')), ' ') AS sp, array_to_string(list_sort(string_split(q, ' ')), ' ') AS sq,
  CASE WHEN p = '' OR q = '' THEN 0.0 WHEN p = q THEN 1.0 WHEN len(list_intersect(ps, qs)) = least(len(ps), len(qs)) THEN greatest(0.9, round_even(least(len(ps), len(qs)) / greatest(len(ps), len(qs)), 4))
   WHEN (length(p) >= 2 AND NOT contains(p, ' ') AND (p = coalesce(qi, '') OR p = coalesce(qj, ''))) OR (length(q) >= 2 AND NOT contains(q, ' ') AND (q = coalesce(pi, '') OR q = coalesce(pj, ''))) THEN 0.9 END AS decided FROM ent),
pw AS (SELECT DISTINCT a_w AS p, b_w AS q FROM ab),
fold(w0, o, i, ws, fired) AS (
  SELECT w0, o, 0, w0, false FROM (SELECT p AS w0, q AS o FROM pw UNION SELECT q, p FROM pw)
  UNION ALL SELECT w0, o, i + 1, CASE WHEN spot > 0 THEN ws[1:spot - 1] || [t] || ws[spot + length(t):len(ws)] ELSE ws END, fired OR spot > 0 FROM (
    SELECT *, CASE WHEN length(t) BETWEEN 2 AND 5 AND regexp_matches(t, '^\\p{{L}}+$') THEN strpos(array_to_string(list_transform(ws, lambda z: CASE WHEN regexp_matches(z, '^\\p{{L}}+$') THEN z[1:1] ELSE '#' END), ''), t) ELSE 0 END AS spot
    FROM (SELECT *, o[i + 1] AS t FROM fold WHERE i < len(o)))),
pr AS (SELECT pw.p, pw.q, f.ws AS fp, g.ws AS fq, f.fired OR g.fired AS fired, list_sort(list_distinct(f.ws)) AS wa, list_sort(list_distinct(g.ws)) AS wb FROM pw JOIN fold f ON f.w0 = pw.p AND f.o = pw.q AND f.i = len(f.o) JOIN fold g ON g.w0 = pw.q AND g.o = pw.p AND g.i = len(g.o)),
pr1 AS (SELECT *, list_sort(list_filter(wa, lambda z: NOT list_contains(wb, z))) AS ox, list_sort(list_filter(wb, lambda z: NOT list_contains(wa, z))) AS oy, len(list_intersect(wa, wb)) AS met,
  coalesce(len(list_intersect(wa, wb)) / nullif(len(list_distinct(wa || wb)), 0), 0.0) AS share, ({_ANT}) AS opposed, array_to_string(list_sort(fp), ' ') AS sp, array_to_string(list_sort(fq), ' ') AS sq FROM pr),
tx AS ({' UNION '.join(f"SELECT {_low(f'a_{c}')} AS p, {_low(f'b_{c}')} AS q FROM ab" for _, c in _TEXTS)}),
tx1 AS (SELECT p, q, list_filter(ps, lambda z: list_contains(qs, z)) AS shr, list_filter(ps, lambda z: NOT list_contains(qs, z)) AS op, list_filter(qs, lambda z: NOT list_contains(ps, z)) AS oq FROM (SELECT p, q, {_sets('p')} AS ps, {_sets('q')} AS qs FROM tx WHERE p <> '' AND q <> '')),
tx2 AS (SELECT *, array_to_string(shr, ' ') AS s, array_to_string(shr || op, ' ') AS sp, array_to_string(shr || oq, ' ') AS sq FROM tx1),
need AS (SELECT DISTINCT x, y FROM (SELECT sp AS x, sq AS y FROM ent1 UNION SELECT sp, sq FROM pr1 UNION SELECT sp, sq FROM tx2 UNION SELECT u1.x, u2.y FROM (SELECT p, q, unnest(ox) AS x FROM pr1) u1 JOIN (SELECT p, q, unnest(oy) AS y FROM pr1) u2 ON u1.p = u2.p AND u1.q = u2.q) WHERE x <> '' AND y <> '' AND x <> y),
lcs(x, y, i, held) AS (
  SELECT x, y, 0, list_transform(range(length(y)), lambda j: 0) FROM need
  UNION ALL SELECT x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(off[1:j])) FROM (
    SELECT x, y, i, list_transform(range(1, length(y) + 1), lambda j: CAST(CASE WHEN y[j:j] = x[i + 1:i + 1] THEN coalesce(held[j - 1], 0) + 1 ELSE held[j] END AS INT)) AS off FROM lcs WHERE i < length(x))),
rat AS (SELECT x, y, 2 * held[length(y)] / (length(x) + length(y)) AS r FROM lcs WHERE i = length(x)),
eg AS (SELECT p, q, pi, pj, qi, qj, coalesce(decided, round_even(rr, 4)) AS ent_score, coalesce(decided > 0, rr >= 0.86 AND met > 0) AS ent_ok FROM (SELECT e.*, CASE WHEN sp = sq THEN 1.0 ELSE coalesce(r, 0.0) END AS rr FROM ent1 e LEFT JOIN rat ON x = sp AND y = sq)),
pg2 AS (SELECT p1.*, greatest(share, 0.9 * CASE WHEN sp = sq THEN 1.0 ELSE coalesce(z.r, 0.0) END) AS s, coalesce(r11.r, 0.0) AS r11, coalesce(r12.r, 0.0) AS r12, coalesce(r21.r, 0.0) AS r21, coalesce(r22.r, 0.0) AS r22 FROM pr1 p1
  LEFT JOIN rat z ON z.x = sp AND z.y = sq LEFT JOIN rat r11 ON r11.x = ox[1] AND r11.y = oy[1] LEFT JOIN rat r12 ON r12.x = ox[1] AND r12.y = oy[2] LEFT JOIN rat r21 ON r21.x = ox[2] AND r21.y = oy[1] LEFT JOIN rat r22 ON r22.x = ox[2] AND r22.y = oy[2]),
pg3 AS (SELECT *, (len(ox) = 1 AND len(oy) = 1 AND r11 >= 0.8) OR (len(ox) = 2 AND len(oy) = 2 AND CASE WHEN r11 >= 0.8 THEN r22 >= 0.8 WHEN r12 >= 0.8 THEN r21 >= 0.8 ELSE false END) AS paired,
  CASE WHEN len(p) = 0 OR len(q) = 0 THEN 1 WHEN len(ox) + len(oy) = 0 THEN 2 WHEN opposed THEN 3 WHEN (len(ox) = 0 OR len(oy) = 0) AND len(ox) + len(oy) > 1 THEN 4
   WHEN (len(ox) = 0 OR len(oy) = 0) AND NOT fired AND len(list_intersect(ox || oy, [{_in(_lex.RATE_TERMS)}])) > 0 THEN 5 WHEN len(ox) = 0 OR len(oy) = 0 THEN 6 WHEN met = 0 OR s < 0.4 THEN 7 END AS why FROM pg2),
pgate AS (SELECT p, q, CASE why WHEN 1 THEN 'different' WHEN 2 THEN 'same' WHEN 3 THEN 'related' WHEN 4 THEN 'related' WHEN 5 THEN 'related' WHEN 6 THEN 'same' WHEN 7 THEN 'different' ELSE CASE WHEN s >= 0.7 AND paired THEN 'same' ELSE 'related' END END AS pred_verdict,
  CASE why WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN round_even(share, 4) WHEN 5 THEN 0.5 WHEN 6 THEN 0.85 ELSE round_even(s, 4) END AS pred_score FROM pg3),
ts AS (SELECT p, q, CASE WHEN p = q THEN 1.0 WHEN len(shr) > 0 AND (len(op) = 0 OR len(oq) = 0) THEN 1.0
  ELSE greatest(CASE WHEN sp = sq THEN 1.0 ELSE coalesce(r, 0.0) END, CASE WHEN len(shr) > 0 THEN greatest(2 * length(s) / (length(s) + length(sp)), 2 * length(s) / (length(s) + length(sq))) ELSE 0.0 END) END AS score FROM tx2 LEFT JOIN rat ON x = sp AND y = sq),
g AS (SELECT ab.*, ent_ok, ent_score, pred_verdict, pred_score FROM ab
  JOIN eg ON eg.p = a_k AND eg.q = b_k AND eg.pi IS NOT DISTINCT FROM a_ik AND eg.pj IS NOT DISTINCT FROM a_jf AND eg.qi IS NOT DISTINCT FROM b_ik AND eg.qj IS NOT DISTINCT FROM b_jf JOIN pgate ON pgate.p = a_w AND pgate.q = b_w)"""


def _field(f: str) -> str:
    a, b = f"trim(coalesce(a_ctx_{f}, ''))", f"trim(coalesce(b_ctx_{f}, ''))"
    one = f"CASE WHEN lower({a} || {b}) IN ({_in(_lex.AGGREGATE_SCOPES)}) THEN 'same' ELSE 'unknown' END" if f == "scope" else "'unknown'"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 'same' WHEN {a} = '' OR {b} = '' THEN {one} WHEN s_{f} >= 0.8 THEN 'same' WHEN s_{f} <= 0.45 THEN 'different' ELSE 'unknown' END AS {f}_v"


def _rank(m: str) -> str:
    return f"CASE {m} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in _lex.REVISION_RANK.items()) + " ELSE 2 END"


_COARSER = "CASE WHEN a_half IS NOT NULL AND b_half IS NOT NULL THEN greatest(a_half, b_half) END"
_OPP = " OR ".join(
    f"((contains(av, '{x}') OR contains(av, '{y}')) AND (contains(bv, '{x}') OR contains(bv, '{y}')) AND NOT ((contains(av, '{x}') AND contains(bv, '{x}')) OR (contains(av, '{y}') AND contains(bv, '{y}'))))" for x, y in _lex.STATUS_OPPOSITES
)
_MAX = "coalesce(list_max({s}_{c}), 0)"
_JUDGED = f"""{_PAIRS},
h AS (SELECT g.*, {', '.join(f't_{n}.score AS s_{n}' for n, _ in _TEXTS)} FROM g {' '.join(f"LEFT JOIN ts t_{n} ON t_{n}.p = {_low(f'a_{c}')} AND t_{n}.q = {_low(f'b_{c}')}" for n, c in _TEXTS)}),
m AS (SELECT *, {', '.join(_field(f) for f in _FIELDS)},
  CASE WHEN NOT a_stated OR NOT b_stated THEN 'unknown' WHEN a_quarters <> b_quarters OR a_halves <> b_halves THEN 'different' WHEN len(a_years) > 0 AND len(b_years) > 0 AND NOT list_has_any(a_years, b_years) THEN 'different' WHEN a_months <> b_months THEN 'different' WHEN a_years = b_years THEN 'same' ELSE 'unknown' END AS period_v,
  CASE WHEN NOT a_stated OR NOT b_stated THEN 0 WHEN list_max(a_years) <> list_max(b_years) THEN 1 WHEN list_max(a_years) IS NOT DISTINCT FROM list_max(b_years) AND ({_MAX.format(s='a', c='quarters')} <> {_MAX.format(s='b', c='quarters')} OR {_MAX.format(s='a', c='months')} <> {_MAX.format(s='b', c='months')}) THEN 1 ELSE 0 END AS ordered,
  CASE WHEN coalesce(a_currency <> b_currency, false) OR a_pct <> b_pct THEN 'incomparable' WHEN (a_currency IS NOT NULL OR a_scale <> 1.0) <> (b_currency IS NOT NULL OR b_scale <> 1.0) THEN 'unknown' ELSE 'same' END AS unit_v,
  CASE WHEN a_x IS NULL AND b_x IS NULL THEN CASE WHEN coalesce(s_value, 1.0) >= 0.92 THEN 'equal' WHEN coalesce(s_value, 1.0) >= 0.72 THEN 'equivalent' ELSE 'differ' END WHEN a_x IS NULL OR b_x IS NULL THEN 'incomparable'
   WHEN a_pct AND b_pct THEN CASE WHEN abs(a_x - b_x) <= greatest(coalesce({_COARSER}, 0.0), 0.05) THEN 'equivalent' ELSE 'differ' END
   WHEN a_x = b_x THEN 'equal' WHEN coalesce(abs(a_x - b_x) <= {_COARSER}, false) OR abs(a_x - b_x) / greatest(abs(a_x), abs(b_x)) <= 0.02 THEN 'equivalent' ELSE 'differ' END AS value_v,
  coalesce(nullif(a_modality, ''), 'reported') AS am, coalesce(nullif(b_modality, ''), 'reported') AS bm, coalesce(lower(a_value), '') AS av, coalesce(lower(b_value), '') AS bv,
  CASE WHEN len(b_w) > 0 AND list_has_all(a_w, b_w) AND NOT list_has_all(b_w, a_w) THEN 1 WHEN len(a_w) > 0 AND list_has_all(b_w, a_w) AND NOT list_has_all(a_w, b_w) THEN -1 ELSE 0 END AS direction FROM h),
e AS (SELECT *, 'different' IN (period_v, {', '.join(f'{f}_v' for f in _FIELDS)}) AS differs, 'unknown' IN (unit_v, period_v, {', '.join(f'{f}_v' for f in _FIELDS)}) AS unsure, value_v IN ('equal', 'equivalent') AS agree, value_v = 'differ' AS differ, ({_OPP}) AS opp,
  lower(trim(coalesce(a_predicate, ''))) = 'status' AND lower(trim(coalesce(b_predicate, ''))) = 'status' AS status, list_has_any(a_w, [{_in(_lex.RATE_TERMS)}]) OR list_has_any(b_w, [{_in(_lex.RATE_TERMS)}]) AS rated,
  coalesce(a_ctx_denominator, '') <> '' OR coalesce(b_ctx_denominator, '') <> '' AS denom,
  coalesce(a_origin = 'table' AND b_origin = 'table', false) AND a_currency IS NULL AND b_currency IS NULL AND NOT a_pct AND NOT b_pct AND a_scale = 1.0 AND b_scale = 1.0 AND coalesce(a_raw, '') = '' AND coalesce(b_raw, '') = '' AS bare,
  CASE WHEN direction <> 0 AND a_x IS NOT NULL AND b_x IS NOT NULL THEN coalesce(abs(CASE WHEN direction = 1 THEN a_x ELSE b_x END) / nullif(abs(CASE WHEN direction = 1 THEN b_x ELSE a_x END), 0), 0.0) END AS part FROM m),
rl AS (SELECT *, CASE WHEN NOT ent_ok THEN 'R00' WHEN pred_verdict = 'different' THEN 'R01' WHEN unit_v = 'incomparable' THEN 'R02' WHEN pred_verdict = 'related' AND part BETWEEN 0.05 AND 1.02 THEN 'R10' WHEN pred_verdict = 'related' AND part < 0.05 THEN 'R11' WHEN pred_verdict = 'related' THEN 'R12'
  WHEN am <> bm AND differ AND period_v IN ('same', 'unknown') AND {_rank('am')} <> {_rank('bm')} THEN 'R20' WHEN status AND agree THEN 'R30' WHEN status AND differ AND ordered <> 0 THEN 'R31' WHEN status AND differ AND opp THEN 'R32' WHEN status AND differ THEN 'R33'
  WHEN agree AND NOT differs THEN 'R40' WHEN differ AND differs THEN 'R50' WHEN agree THEN 'R51' WHEN differ AND unsure THEN 'R60' WHEN differ AND a_pct AND b_pct AND NOT rated AND NOT denom THEN 'R61' WHEN differ AND bare AND NOT rated THEN 'R62' WHEN differ THEN 'R70' ELSE 'R99' END AS rule_id FROM e),
rules(rule_id, kind, rel, escalate) AS (VALUES {', '.join(f"('{a}', '{b}', CAST({c} AS DOUBLE), {str(d).lower()})" for a, b, c, d in _lex.RULES)}),
jd AS (SELECT rl.*, kind, escalate, rel, sha256(least(a_id, b_id) || '|' || greatest(a_id, b_id))[1:20] AS pair_id, CASE rl.rule_id WHEN 'R00' THEN ent_score WHEN 'R01' THEN pred_score ELSE CASE WHEN pred_score = 0 THEN ent_score * 0.5 ELSE least(1.0, ent_score * 0.5 + pred_score * 0.5) END END AS sure,
  least(coalesce(a_final_confidence, 0.0), coalesce(b_final_confidence, 0.0)) AS weakest FROM rl JOIN rules USING (rule_id))"""
_R = "WITH RECURSIVE " + _PAIRS.removeprefix("WITH ")
_J = "WITH RECURSIVE " + _JUDGED.removeprefix("WITH ")
_PASSED = "rule_id NOT IN ('R00', 'R01')"

ORACLE |= {
    "same_entity_fuzzy": f"{_R} SELECT relation_id, ent_ok, CAST(ent_score AS DOUBLE) AS ent_score FROM g",
    "same_predicate_fuzzy": f"{_R} SELECT relation_id, pred_verdict, CAST(pred_score AS DOUBLE) AS pred_score FROM g",
    "cascade_verdicts": f"{_J} SELECT pair_id AS relation_id, kind, rule_id, CAST(floor(greatest(0.0, least(1.0, weakest * sure * rel)) * 10000 + 0.5) / 10000 AS DOUBLE) AS confidence, CASE WHEN {_PASSED} THEN value_v END AS value_agreement, escalate FROM jd",
    "verdicts_by_rule": f"{_J} SELECT rule_id, kind, count(*) AS pairs FROM jd GROUP BY 1, 2",
    "status_verdicts": f"{_J} SELECT pair_id AS relation_id, kind, rule_id FROM jd WHERE status",
    "context_differences": f"{_J} " + " UNION ALL ".join(f"SELECT pair_id AS relation_id, '{f}' AS field FROM jd WHERE {_PASSED} AND {f}_v = 'different'" for f in ("period", *_FIELDS)),
    "replay_drift": f"{_J} SELECT old.kind AS old_kind, jd.kind AS kind, count(*) AS pairs FROM jd JOIN r old ON old.relation_id = jd.relation_id GROUP BY 1, 2",
    "text_field_check": f"{_J} SELECT relation_id, scope_v, basis_v, geography_v, denominator_v, as_of_v FROM jd WHERE {_PASSED}",
    "value_check_all": f"{_J} SELECT relation_id, value_v AS verdict FROM jd WHERE {_PASSED}",
}

# The same over the blocked candidates instead of stored relations: name and property pass the gates there as a rule, so the
# rules behind them are met.
_CAND = _BLOCK.removeprefix(f"{_W}, {_V}, ") + ", " + _TOPK.format(where="").replace(") SELECT DISTINCT", "), cand AS (SELECT DISTINCT") + ")"
_JC = "WITH RECURSIVE " + _JUDGED.removeprefix("WITH ").replace(
    "ab AS (SELECT r.relation_id,", f"{_CAND},\nab AS (SELECT r.a_id || r.b_id AS relation_id,"
).replace("FROM r JOIN cl a ON a.claim_id = r.claim_a_id JOIN cl b ON b.claim_id = r.claim_b_id", "FROM cand r JOIN cl a ON a.claim_id = r.a_id JOIN cl b ON b.claim_id = r.b_id")
ORACLE |= {
    "candidate_verdicts": f"{_JC} SELECT pair_id AS relation_id, kind, rule_id, CAST(floor(greatest(0.0, least(1.0, weakest * sure * rel)) * 10000 + 0.5) / 10000 AS DOUBLE) AS confidence, CASE WHEN {_PASSED} THEN value_v END AS value_agreement, escalate FROM jd",
    "candidate_rules": f"{_JC} SELECT rule_id, kind, count(*) AS pairs FROM jd GROUP BY 1, 2",
}
ORACLE["component_sibling_sums"] = f"""{_CLAIMS}, pq AS (SELECT relation_id, a.claim_id AS a_id, b.claim_id AS b_id, a.value_num AS a_v, b.value_num AS b_v, a.ctx_period AS a_p, b.ctx_period AS b_p, list_sort(list_distinct(a.w)) AS aw, list_sort(list_distinct(b.w)) AS bw
  FROM r JOIN cl a ON a.claim_id = r.claim_a_id JOIN cl b ON b.claim_id = r.claim_b_id WHERE rule_id = 'R10'),
 sd AS (SELECT relation_id, b_id AS whole_id, b_v AS whole, a_p AS period, aw AS ws, abs(a_v) AS amount FROM pq WHERE abs(a_v) < abs(b_v) AND len(aw) > len(bw) UNION ALL SELECT relation_id, a_id, a_v, b_p, bw, abs(b_v) FROM pq WHERE abs(b_v) < abs(a_v) AND len(bw) > len(aw)),
 mx AS (SELECT whole_id, whole, period, ws, max(amount) AS amount FROM sd GROUP BY ALL), sm AS (SELECT whole_id, period, count(*) AS parts, CAST(sum(CAST(amount AS DECIMAL(28,4))) AS DOUBLE) AS total, any_value(whole) AS whole FROM mx GROUP BY 1, 2)
 SELECT relation_id, parts, coalesce(abs(1 - total / nullif(abs(sm.whole), 0)) <= 0.05, false) AND parts >= 2 AS confirmed FROM sd JOIN sm ON sm.whole_id = sd.whole_id AND sm.period IS NOT DISTINCT FROM sd.period"""
