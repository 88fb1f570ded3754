"""The same results in DuckDB's SQL, where SQL can express them on whole tables."""

_LINKS = """
SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM (
  SELECT lower(trim(claim_a_id, chr(32) || chr(9) || chr(10) || chr(13))) AS a, lower(trim(claim_b_id, chr(32) || chr(9) || chr(10) || chr(13))) AS b
  FROM relations WHERE lower(trim(kind, chr(32) || chr(9) || chr(10) || chr(13))) IN ('corroboration', 'supersedes'))
WHERE a <> '' AND b <> ''
"""
_GROUPS = f"""
links AS ({_LINKS}),
both_ways AS (SELECT lo AS x, hi AS y FROM links UNION SELECT hi, lo FROM links),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
grouped AS (SELECT x AS claim_id, min(y) AS group_id FROM reach GROUP BY x)
"""
# What a text says, by steps without looking around: points inside numbers and signs of numbers are marked, all else that
# isn't content goes, the marks become signs again. Each step runs twice, as two matches can share a character.
_MONEY = r"(?:rs\.?|inr|usd|us\$|us dollars|eur|euros?|gbp|jpy|yen|pounds sterling|rupees|[₹$€£¥])"
_NUM = rf"\s*(?:{_MONEY}\s*)?\.?\p{{Nd}}"


def _twice(text: str, pattern: str, to: str) -> str:
    once = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return f"regexp_replace({once}, '{pattern}', {to}, 'g')"


def _said(c: str) -> str:
    t = _twice(f"lower(coalesce({c}, ''))", r"(\p{Nd})\.(\p{Nd})", r"'\1' || chr(1) || '\2'")
    t = _twice(t, rf"(^|[^\p{{L}}\p{{Nd}}])[-−]({_NUM})", r"'\1' || chr(2) || '\2'")
    t = _twice(t, rf"\(({_NUM})", r"chr(3) || '\1'")
    return rf"translate(regexp_replace({t}, '[^\p{{L}}\p{{Nd}}%‰₹$€£¥' || chr(1) || chr(2) || chr(3) || ']', '', 'g'), chr(1) || chr(2) || chr(3), '.-(')"


_COPIES = f"""
said AS (SELECT DISTINCT lower(trim(claim_id, chr(32) || chr(9) || chr(10) || chr(13))) AS claim_id, list_sort([{_said('subject')}, {_said('predicate')}, {_said('value')}]) AS says FROM claims),
kept AS (SELECT claim_id, min(claim_id) OVER (PARTITION BY says) AS keep_id, count(*) OVER (PARTITION BY says) AS n FROM said WHERE claim_id <> '' AND says <> ['', '', ''])
"""
ORACLE = {
    "p2_found": f"WITH {_COPIES} SELECT claim_id, keep_id FROM kept WHERE n > 1",
    "p2_copies": f"WITH {_COPIES} SELECT keep_id, count(*) AS copies FROM kept WHERE n > 1 GROUP BY 1",
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT claim_id, group_id FROM grouped",
    "p1_group_sizes": f"WITH RECURSIVE {_GROUPS}, sizes AS (SELECT group_id, count(*) AS members FROM grouped GROUP BY 1) SELECT members, count(*) AS groups FROM sizes GROUP BY 1",
    "p8_round_trip": "SELECT doc_id, true AS same FROM documents",
}
