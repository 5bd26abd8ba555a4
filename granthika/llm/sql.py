"""DuckDB SQL that states the same results independently."""

from __future__ import annotations

# The log read plainly: one window per session, no parts, versions and markers. A notice is told by its words: each is
# one of a server's notices, and one of them says that something failed.
_WORDS = "sorry apologies oops something went wrong on our side end http error status code the answer service server internal gateway bad model request response connection connect network upstream generation is are not available unavailable temporarily currently overloaded timed out timeout refused reset closed failed aborted please try again later an unexpected occurred has".split()
_FAILS = "error wrong failed aborted refused reset timeout timed unavailable available overloaded".split()
_listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_P4_LOG = rf"""
WITH m AS (
  SELECT session_id, id, user_id, text,
    CASE WHEN regexp_replace(lower(role), '\s+', '', 'g') IN ('user', 'human', 'citizen', 'customer') THEN 'user'
         WHEN regexp_replace(lower(role), '\s+', '', 'g') IN ('assistant', 'bot', 'ai', 'model') THEN 'assistant'
         WHEN regexp_replace(lower(role), '\s+', '', 'g') = 'system' THEN 'system' END AS speaker,
    CASE WHEN created_at > 1e17 THEN created_at / 1e9 WHEN created_at > 1e14 THEN created_at / 1e6
         WHEN created_at > 1e11 THEN created_at / 1e3 WHEN created_at > 0 THEN created_at END AS t,
    length(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\p{{C}}]+', '', 'g')) > 0 AS seen,
    regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS words
  FROM chat_messages WHERE session_id IS NOT NULL),
r AS (
  SELECT *, lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND lag(coalesce(text, '')) OVER w = coalesce(text, '') AND t - lag(t) OVER w <= 4 AS retry
  FROM m WHERE t IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY t, id)),
turns AS (
  SELECT * FROM r WHERE seen AND speaker IN ('user', 'assistant') AND NOT coalesce(retry, false)
    AND NOT (speaker = 'assistant' AND len(list_filter(words, lambda x: NOT regexp_matches(x, '^[45]\d\d$') AND NOT list_contains({_listed(_WORDS)}, x))) = 0
      AND list_has_any(words, {_listed(_FAILS)}))),
chain AS (
  SELECT session_id, id, t, text, speaker, lead(speaker) OVER w AS nxt, row_number() OVER w AS n FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY t, id)),
flags AS (
  SELECT session_id, bool_or(speaker = 'user' AND (nxt IS NULL OR nxt = 'user')) AS no_reply, max(CASE WHEN n = 1 THEN speaker END) AS first_role FROM chain GROUP BY 1),
per AS (
  SELECT session_id, bool_or(seen) AS any_seen, bool_or(speaker IS NULL OR t IS NULL) AS bad_row, count(DISTINCT coalesce(user_id, -1)) > 1 AS many FROM m GROUP BY 1),
ids AS (SELECT id AS session_id FROM chat_sessions UNION SELECT session_id FROM chat_messages),
verdict AS (
  SELECT ids.session_id,
    CASE WHEN NOT coalesce(any_seen, false) THEN 'empty' WHEN bad_row OR many OR coalesce(first_role, '') <> 'user' THEN 'broken' WHEN no_reply THEN 'no_reply' END AS reason
  FROM ids LEFT JOIN per USING (session_id) LEFT JOIN flags USING (session_id) WHERE ids.session_id IS NOT NULL)
"""

P4_FOUND = _P4_LOG + "SELECT session_id, reason FROM verdict WHERE reason IS NOT NULL"
P4_TURNS = _P4_LOG + "SELECT session_id, n AS turn_no, speaker AS role, id, t AS said_at, text FROM chain JOIN verdict USING (session_id) WHERE reason IS NULL"


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p4_turns": P4_TURNS}
