"""SQL for the queries that SQL can express on whole tables."""

_RENDERED = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"


def _side(name: str, even: int) -> str:
    """Completion and mask of one side, from the turns behind the common prefix."""
    return f"""
    {name}_rest AS (
      SELECT t.*, {_RENDERED} AS shown,
             coalesce(sum(length({_RENDERED})) OVER (
               PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               + length(role) + 5 AS begins
      FROM turns t JOIN prefix USING (pair_id) WHERE side = {even} AND i > n_prefix
    ),
    {name}_text AS (
      SELECT pair_id, string_agg(shown, '' ORDER BY i) AS completion,
             string_agg(CASE WHEN role = 'assistant' THEN CAST(begins AS BIGINT) || ':' ||
                        CAST(begins + length(text) + 7 AS BIGINT) END, ',' ORDER BY i) AS mask
      FROM {name}_rest GROUP BY pair_id
    )
    """


CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
last AS (
  SELECT conv_id, turn, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) AS back
    FROM said WHERE role = 'assistant'
  ) WHERE back = 1
),
sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM said
  UNION ALL
  SELECT s.conv_id, 1, s.turn, s.role,
         CASE WHEN s.role = 'assistant' AND s.turn IS NOT DISTINCT FROM l.turn AND s.text = l.text
              THEN coalesce(o.text, '') ELSE s.text END
  FROM said s LEFT JOIN last l ON l.conv_id = s.conv_id LEFT JOIN last o ON o.conv_id = s.conv_id + 1
),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i
  FROM sides
),
whole AS (SELECT pair_id FROM turns GROUP BY pair_id HAVING count(DISTINCT side) = 2),
prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN same THEN NULL ELSE i END), max(i) + 1) - 1 AS n_prefix
  FROM (
    SELECT pair_id, i, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
    FROM turns JOIN whole USING (pair_id) GROUP BY pair_id, i
  ) GROUP BY pair_id
),
prompts AS (
  SELECT pair_id, string_agg({_RENDERED}, '' ORDER BY i) AS prompt
  FROM turns JOIN prefix USING (pair_id) WHERE side = 0 AND i <= n_prefix GROUP BY pair_id
),
{_side("chosen", 0)},
{_side("rejected", 1)}
SELECT pair_id, pair_id AS chosen_id, pair_id AS rejected_id,
       CAST(n_prefix AS INTEGER) AS n_prefix, coalesce(prompt, '') AS prompt,
       coalesce(c.completion, '') AS chosen, coalesce(r.completion, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM prefix LEFT JOIN prompts USING (pair_id)
     LEFT JOIN chosen_text c USING (pair_id) LEFT JOIN rejected_text r USING (pair_id)
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, n_docs
),
asked AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         unnest(regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
scores AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT)
           AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0
) WHERE rank <= 10
"""

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(string_split({_FOLDED}, chr(10))) AS folded,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
),
keyed AS (
  SELECT *, trim(folded, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
),
frequent AS (SELECT key FROM keyed WHERE key != '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""

ORACLES = {"op7_chat_preferences": CHAT, "op11_lexical_search": SEARCH, "op12_line_dedup": LINES}
