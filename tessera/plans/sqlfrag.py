"""DuckDB SQL fragments shared by the oracle queries (same rules as the
Spark operators, written independently in SQL)."""

PIECE_RE = r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"


def tokens_cte(src: str, key: str = "doc_id", text: str = "text", name: str = "tokens") -> str:
    """CTE chain ending in ``name(key, tok_idx, begin, "end", token, word_idx)``."""
    return f"""
{name}_p AS (
  SELECT {key}, unnest(p) AS piece, unnest(range(len(p))) AS tok_idx
  FROM (SELECT {key}, regexp_extract_all({text}, '{PIECE_RE}') AS p FROM {src})
),
{name}_q AS (
  SELECT {key}, tok_idx, piece,
         length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS lead,
         coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY tok_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM {name}_p
),
{name}_r AS (
  SELECT {key}, tok_idx, CAST(start + lead AS BIGINT) AS begin, CAST(start + length(piece) AS BIGINT) AS "end",
         substring(piece, lead + 1) AS token,
         CASE WHEN regexp_matches(substring(piece, lead + 1), '^[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END AS w
  FROM {name}_q
),
{name} AS (
  SELECT {key}, tok_idx, begin, "end", token,
         CAST(CASE WHEN w = 1 THEN sum(w) OVER (PARTITION BY {key} ORDER BY tok_idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS BIGINT) AS word_idx
  FROM {name}_r
)"""


def sentences_cte(tokens: str = "tokens", key: str = "doc_id", name: str = "sentences") -> str:
    """``name(key, sent_idx, begin, "end", n_tokens)`` plus ``{name}_t``:
    tokens with ``sent_idx``."""
    return f"""
{name}_f AS (
  SELECT *,
    CASE WHEN lead(begin) OVER w IS NULL THEN 1
         WHEN lead(begin) OVER w > "end" AND (token IN ('.', '?', '!')
              OR (token IN ('"', '''', ')', ']', '}}', '»', '”', '’')
                  AND lag(token) OVER w IN ('.', '?', '!') AND lag("end") OVER w = begin))
         THEN 1 ELSE 0 END AS is_end
  FROM {tokens} WINDOW w AS (PARTITION BY {key} ORDER BY tok_idx)
),
{name}_t AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY {key} ORDER BY tok_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_idx
  FROM {name}_f
),
{name} AS (
  SELECT {key}, sent_idx, min(begin) AS begin, max("end") AS "end", count(*) AS n_tokens
  FROM {name}_t GROUP BY {key}, sent_idx
)"""
