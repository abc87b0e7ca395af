"""DuckDB SQL for those of the ten queries that SQL can express."""

from __future__ import annotations

from quern.llm import chat, mixing, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(col: str) -> str:
    out = rf"replace({col}, '\', '\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    return out


_MARKS = len(chat.OPEN + chat.ROLE_END + chat.TEXT_END + chat.CLOSE)

OP1 = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
   sum({_MARKS} + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM whole
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
 s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 s1 AS (SELECT *, source_size * {mixing.MAX_REPEATS} AS cap, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s0),
 s2 AS (SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER upto - cap AS before, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on
   FROM s1 WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
 s3 AS (SELECT *, (total - before)::DOUBLE * weight >= cap::DOUBLE * weight_on AS capped FROM s2),
 s4 AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0)) END AS target FROM s3),
 s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM s4),
 s6 AS (SELECT *, floor(target + 0.5)::BIGINT - passes * source_size AS rest FROM s5),
 unit AS (SELECT source, key, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
 queue AS (SELECT source, key, words, row_number() OVER (PARTITION BY source ORDER BY key) AS k FROM unit),
 walk AS (SELECT source, 0::BIGINT AS k, rest AS room, NULL::VARCHAR AS key, false AS picked FROM s6
   UNION ALL SELECT q.source, q.k, CASE WHEN q.words <= w.room THEN w.room - q.words ELSE w.room END, q.key, q.words <= w.room
   FROM walk w JOIN queue q ON w.source IS NOT DISTINCT FROM q.source AND q.k = w.k + 1)
SELECT d.doc_id, d.size, s6.source_size, s6.target, CASE WHEN d.size > 0 THEN (s6.passes + (w.picked IS NOT NULL)::BIGINT) * d.size ELSE 0 END AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
 LEFT JOIN walk w ON w.picked AND d.source IS NOT DISTINCT FROM w.source AND d.key = w.key
"""

OP4 = r"""
WITH word AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
 posting AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
 length AS (SELECT doc_id, sum(tf) AS n FROM posting GROUP BY 1),
 corpus AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM length),
 weight AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posting, corpus GROUP BY term, docs),
 pair AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
          FROM posting q JOIN posting p USING (term) JOIN weight USING (term) JOIN length ON length.doc_id = p.doc_id, corpus
          WHERE q.doc_id % 20 = 0 GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pair)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 10
"""

_KINDS = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.EXTRA]
_SUM = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)::BIGINT"

OP5 = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || chr(10) || coalesce(lang, '') AS repo, coalesce(text, '') AS text FROM documents),
 raw AS ({" UNION ALL ".join(f"SELECT *, {k} AS rank, regexp_extract_all(text, {_quoted(p)}) AS m, regexp_split_to_array(text, {_quoted(p)}) AS gap FROM t WHERE regexp_matches(text, {_quoted(p)})" for k, p in enumerate(_KINDS))}),
 hit AS (SELECT doc_id, owner, repo, rank, m[i] AS whole, {_SUM("gap[1:i]")} + {_SUM("m[1:i - 1]")} AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
 span AS (SELECT *, s + length(whole) AS e, CASE rank WHEN 0 THEN regexp_extract(whole, {_quoted(secrets.ASSIGN)}, 2) ELSE whole END AS v FROM hit WHERE CASE rank
   WHEN 0 THEN length(regexp_extract(whole, {_quoted(secrets.ASSIGN)}, 2)) >= 6 WHEN 1 THEN length(whole) >= 20 WHEN 2 THEN length(whole) >= 24 ELSE true END),
 own AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM span GROUP BY v),
 seen AS (SELECT span.*, owners, repos, owners <= {secrets.MAX_OWNERS} AND repos <= {secrets.MAX_REPOS} AS live FROM span JOIN own USING (v)),
 kept AS (SELECT * FROM seen x WHERE rank < 3 OR live AND len(list_distinct(string_split(v, ''))) >= {secrets.LEAST_SIGNS}
   AND (regexp_matches(v, '{secrets.PREFIXED}') OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))
   AND NOT EXISTS (SELECT 1 FROM seen b WHERE b.rank < 3 AND b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
 said AS (SELECT *, {list(secrets.KINDS)}[rank + 1] || ':' || s || ':' || e AS said, owners || ':' || repos || ':' || CASE WHEN live THEN 'live' ELSE 'copied' END AS verdict FROM kept)
SELECT t.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
 sha256(coalesce(string_agg(said, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY s, rank), '') AS spans,
 count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, coalesce(string_agg(verdict, ',' ORDER BY s, rank), '') AS verdicts
FROM t LEFT JOIN said USING (doc_id) GROUP BY t.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": OP1, "op3_mixing": OP3, "op4_top_k_search": OP4, "op5_secret_scans": OP5}
