"""DuckDB statements for the registered queries."""

from __future__ import annotations

from selectra.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
arrays AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM arrays)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(lines, lambda x: length(x) < 30)) AS n_short,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM arrays a LEFT JOIN covered c ON a.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 100000 AND word_chars / n_words BETWEEN 2.0 AND 12.0
       AND n_symbols / word_chars <= 0.10 AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.30
       AND n_short / n_lines <= 0.80 AND n_repeat_words / n_words <= 0.50 AS kept
FROM judged"""


_USABLE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

NEGATIVES_SQL = f"""
WITH rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
scored AS MATERIALIZED (
  SELECT a.uid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS nth
                 FROM scored WHERE same AND vec_id <> anchor_id) WHERE nth <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.uid, p.nth ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.uid = n.uid AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10"""


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of nearest entries (least distance, then least index, in one number) and floored means."""
    nearest = """SELECT q.u, q.p, any_value(q.x) AS x,
        min(256 * CAST(list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, b.x) + list_inner_product(b.x, b.x)
                       AS BIGINT) + b.e) AS m
      FROM quarters q JOIN book{0} b USING (p) GROUP BY q.u, q.p"""
    steps = []
    for i in range(rounds):
        steps.append(f"""near{i} AS MATERIALIZED ({nearest.format(i)}),
    book{i + 1} AS MATERIALIZED (
      SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book{i} b LEFT JOIN (
        SELECT p, e, list(c ORDER BY k) AS x FROM (
          SELECT p, m % 256 AS e, k, floor(sum(x[k]) / count(*)) AS c
          FROM near{i}, (SELECT unnest(range(1, 17)) AS k) GROUP BY ALL) GROUP BY ALL) n USING (p, e))""")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id) AS u, vec_id, label,
             list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE {_USABLE}),
    quarters AS MATERIALIZED (SELECT u, p, v[16 * p + 1:16 * p + 16] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
    book0 AS MATERIALIZED (SELECT p, u - 1 AS e, x FROM quarters WHERE u <= 256),
    {", ".join(steps)},
    last AS MATERIALIZED ({nearest.format(rounds)}),
    coded AS (
      SELECT u, string_agg(lpad(printf('%x', CAST(m % 256 AS INTEGER)), 2, '0'), '' ORDER BY p) AS code,
             CAST(sum(m // 256) AS BIGINT) AS error FROM last GROUP BY u),
    books AS (
      SELECT sha256(string_agg(CAST(CAST(x[k] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS h
      FROM book{rounds}, (SELECT unnest(range(1, 17)) AS k))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           h AS codebooks_sha256
    FROM kept JOIN coded USING (u), books"""


CODES_SQL = _codes_sql()
