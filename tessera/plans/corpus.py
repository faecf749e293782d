"""Driver queries over the document table: tokens, sentences, span joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spans import covered_by, intersects
from tessera.operators.tokens import by_document, split_sentences, split_sentences_cautious, tokenize
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sentences_cte, tokens_cte
from tessera.util import materialize, read_table, text_partitions

TOK = tokens_cte("documents")
SENT = sentences_cte()


def docs(spark, sf) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


def bigint(df: DataFrame, *cols) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in cols else F.col(c) for c in df.columns])


@register("tokenize_offsets", sql=f"""WITH {TOK}
SELECT doc_id, CAST(tok_idx AS BIGINT) AS tok_idx, CAST(begin AS BIGINT) AS begin,
       CAST("end" AS BIGINT) AS "end", token, CAST(word_idx AS BIGINT) AS word_idx FROM tokens""")
def q_tokenize_offsets(spark, sf):
    return bigint(tokenize(docs(spark, sf)), "tok_idx", "begin", "end", "word_idx")


@register("sentences", sql=f"""WITH {TOK}, {SENT}
SELECT doc_id, CAST(sent_idx AS BIGINT) AS sent_idx, CAST(begin AS BIGINT) AS begin,
       CAST("end" AS BIGINT) AS "end", CAST(n_tokens AS BIGINT) AS n_tokens
FROM sentences""")
def q_sentences(spark, sf):
    s = split_sentences(tokenize(docs(spark, sf)))
    return bigint(s, "sent_idx", "begin", "end", "n_tokens")


def short_word_mentions(tokens: DataFrame) -> DataFrame:
    """Test mentions that straddle a full stop: a word of at most two
    characters, a glued ``.``, and the next token (``la. Ouré`` style
    abbreviations)."""
    w = Window.partitionBy("doc_id").orderBy("tok_idx")
    t = tokens.select("doc_id", "tok_idx", "begin", "end", "token", "word_idx",
                      F.lead("token", 1).over(w).alias("t1"), F.lead("begin", 1).over(w).alias("b1"),
                      F.lead("end", 2).over(w).alias("e2"))
    return t.where(F.col("word_idx").isNotNull() & (F.length("token") <= 2) & (F.col("t1") == ".")
                   & (F.col("b1") == F.col("end")) & F.col("e2").isNotNull()).select(
        "doc_id", "begin", F.col("e2").alias("end"))


MENTIONS_SQL = """
mentions AS (
  SELECT doc_id, begin, e2 AS "end" FROM (
    SELECT *, lead(token, 1) OVER w AS t1, lead(begin, 1) OVER w AS b1, lead("end", 2) OVER w AS e2
    FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx))
  WHERE word_idx IS NOT NULL AND length(token) <= 2 AND t1 = '.' AND b1 = "end" AND e2 IS NOT NULL
)"""


@register("sentences_cautious", sql=f"""WITH {TOK}, {SENT}, {MENTIONS_SQL},
kept AS (
  SELECT s.doc_id, s."end" AS pos FROM sentences s
  WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.doc_id = s.doc_id
                    AND m.begin <= s."end" AND s."end" < m."end")
)
SELECT doc_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS sent_idx,
       CAST(coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 1, 0) AS BIGINT) AS begin,
       CAST(pos AS BIGINT) AS "end"
FROM kept""")
def q_sentences_cautious(spark, sf):
    tok = tokenize(docs(spark, sf))
    s = split_sentences_cautious(tok, short_word_mentions(tok))
    return bigint(s, "sent_idx", "begin", "end")


@register("covered_by", sql=f"""WITH {TOK}, {SENT}
SELECT s.doc_id, CAST(s.sent_idx AS BIGINT) AS sent_idx, CAST(count(*) AS BIGINT) AS n_covered,
       CAST(min(t.tok_idx) AS BIGINT) AS first_tok, CAST(max(t.tok_idx) AS BIGINT) AS last_tok,
       CAST(sum(length(t.token)) AS BIGINT) AS n_chars
FROM sentences s JOIN tokens t ON s.doc_id = t.doc_id AND s.begin <= t.begin AND t."end" <= s."end"
GROUP BY s.doc_id, s.sent_idx""")
def q_covered_by(spark, sf):
    tok = tokenize(docs(spark, sf))
    sent = split_sentences(tok).select("doc_id", "sent_idx", F.col("begin").alias("o_begin"),
                                      F.col("end").alias("o_end"))
    inner = tok.select("doc_id", "tok_idx", "token", F.col("begin").alias("i_begin"),
                       F.col("end").alias("i_end"))
    pairs = covered_by(sent, inner)
    out = pairs.groupBy("doc_id", "sent_idx").agg(
        F.count(F.lit(1)).alias("n_covered"), F.min("tok_idx").alias("first_tok"),
        F.max("tok_idx").alias("last_tok"), F.sum(F.length("token")).alias("n_chars"))
    return bigint(out, "sent_idx", "n_covered", "first_tok", "last_tok", "n_chars")


def line_spans(d: DataFrame) -> DataFrame:
    """Lines of each document as section spans ``doc_id, line_no, begin, end``."""
    p = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_s", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    return p.select("doc_id", "line_no", F.col("_s").alias("begin"),
                    (F.col("_s") + F.length("line")).alias("end"))


@register("section_mentions", sql=f"""WITH {TOK},
lines_p AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT doc_id, line_no,
            coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin,
            coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) AS "end"
          FROM lines_p),
caps AS (
  SELECT doc_id, min(begin) AS begin, max("end") AS "end" FROM (
    SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS grp FROM (
      SELECT *, CASE WHEN regexp_matches(token, '^\\p{{Lu}}') AND
                     coalesce(lag(regexp_matches(token, '^\\p{{Lu}}')) OVER w, false) AND
                     lag("end") OVER w + 1 = begin THEN 0 ELSE 1 END AS brk
      FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)))
  WHERE regexp_matches(token, '^\\p{{Lu}}') GROUP BY doc_id, grp
)
SELECT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no, CAST(count(*) AS BIGINT) AS n_mentions,
       CAST(min(c.begin) AS BIGINT) AS first_begin, CAST(max(c."end") AS BIGINT) AS last_end
FROM lines l JOIN caps c ON l.doc_id = c.doc_id AND l.begin < c."end" AND c.begin < l."end"
GROUP BY l.doc_id, l.line_no""")
def q_section_mentions(spark, sf):
    from tessera.plans.tagging import capital_runs
    d = docs(spark, sf)
    tok = tokenize(d)
    caps = capital_runs(tok).select("doc_id", F.col("begin").alias("b_begin"), F.col("end").alias("b_end"))
    lines = line_spans(d).select("doc_id", "line_no", F.col("begin").alias("a_begin"),
                                 F.col("end").alias("a_end"))
    pairs = intersects(lines, caps)
    out = pairs.groupBy("doc_id", "line_no").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.min("b_begin").alias("first_begin"),
        F.max("b_end").alias("last_end"))
    return bigint(out, "line_no", "n_mentions", "first_begin", "last_end")


# ----------------------------------------------------------- P2 / P3

def digit_ops(tok: DataFrame) -> DataFrame:
    """Replacement ops: every all-digit token becomes ``<num>``."""
    return tok.where(F.col("token").rlike(r"^\p{N}+$")).select(
        "doc_id", "begin", "end", F.lit("<num>").alias("replacement"))


EDIT_SQL = f"""{TOK},
ops AS (SELECT doc_id, begin, "end", '<num>' AS rep,
               row_number() OVER (PARTITION BY doc_id ORDER BY begin, "end") AS k,
               coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY begin, "end"), 0) AS prev
        FROM tokens WHERE regexp_matches(token, '^\\p{{N}}+$')),
segs0 AS (
  SELECT doc_id, prev AS ob, begin AS oe, false AS replaced, NULL AS rep, k FROM ops WHERE begin > prev
  UNION ALL SELECT doc_id, begin, "end", true, rep, k FROM ops
  UNION ALL SELECT d.doc_id, coalesce(m.last, 0), length(d.text), false, NULL, coalesce(m.kk, 0) + 1
    FROM documents d LEFT JOIN (SELECT doc_id, max("end") AS last, max(k) AS kk FROM ops GROUP BY doc_id) m USING (doc_id)
    WHERE length(d.text) > coalesce(m.last, 0)),
segs AS (
  SELECT *, CAST(coalesce(sum(pl) OVER (PARTITION BY doc_id ORDER BY ob, oe, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS nb
  FROM (SELECT *, CASE WHEN replaced THEN length(rep) ELSE oe - ob END AS pl FROM segs0)),
segs2 AS (SELECT *, nb + pl AS ne FROM segs),
newdocs AS (
  SELECT s.doc_id, string_agg(CASE WHEN s.replaced THEN s.rep ELSE substring(d.text, s.ob + 1, s.oe - s.ob) END, ''
                              ORDER BY s.ob, s.oe, s.k) AS text,
         sum(CASE WHEN s.replaced THEN 1 ELSE 0 END) AS n_ops
  FROM segs2 s JOIN documents d USING (doc_id) GROUP BY s.doc_id)"""


@register("replace_spans", sql=f"""WITH {EDIT_SQL}
SELECT doc_id, CAST(n_ops AS BIGINT) AS n_ops, CAST(length(text) AS BIGINT) AS new_len, md5(text) AS text_md5
FROM newdocs""")
def q_replace_spans(spark, sf):
    from tessera.operators.edits import replace_spans
    d = docs(spark, sf)
    nd, _, _ = replace_spans(d, digit_ops(tokenize(d)))
    return bigint(nd.select("doc_id", "n_ops", F.length("text").alias("new_len"), F.md5("text").alias("text_md5")),
                  "n_ops", "new_len")


def _map_sql(pt: str, as_end: bool) -> str:
    """As-of join of a token border with the segments' new offsets: a begin
    lies in the last segment that starts at or before it, an end in the last
    that starts before it (no segment is empty)."""
    inside = f"s.replaced AND t.{pt} > s.nb AND t.{pt} < s.ne"
    exact = f"CASE WHEN t.{pt} = s.nb THEN s.ob WHEN t.{pt} = s.ne THEN s.oe ELSE s.ob + (t.{pt} - s.nb) END"
    rel = "s.oe" if as_end else "s.ob"
    return f"""
map_{pt} AS (
  SELECT t.doc_id, t.tok_idx,
      CASE WHEN {inside} THEN {rel} ELSE {exact} END AS {pt}_relaxed,
      CASE WHEN {inside} THEN NULL ELSE {exact} END AS {pt}_strict,
      CASE WHEN {inside} THEN s.ob ELSE {exact} END AS {pt}_backward,
      CASE WHEN {inside} THEN s.oe ELSE {exact} END AS {pt}_forward
  FROM ntok t ASOF LEFT JOIN segs2 s ON s.doc_id = t.doc_id AND t.{pt} {">" if as_end else ">="} s.nb)"""


@register("original_span", sql=f"""WITH {EDIT_SQL}, {tokens_cte("newdocs", name="ntok")},
{_map_sql("begin", False)}, {_map_sql("end", True)}
SELECT t.doc_id, CAST(t.tok_idx AS BIGINT) AS tok_idx, CAST(t.begin AS BIGINT) AS begin, CAST(t."end" AS BIGINT) AS "end",
       CAST(begin_relaxed AS BIGINT) AS begin_relaxed, CAST(begin_strict AS BIGINT) AS begin_strict,
       CAST(begin_backward AS BIGINT) AS begin_backward, CAST(begin_forward AS BIGINT) AS begin_forward,
       CAST(end_relaxed AS BIGINT) AS end_relaxed, CAST(end_strict AS BIGINT) AS end_strict,
       CAST(end_backward AS BIGINT) AS end_backward, CAST(end_forward AS BIGINT) AS end_forward
FROM ntok t JOIN map_begin USING (doc_id, tok_idx) JOIN map_end USING (doc_id, tok_idx)""")
def q_original_span(spark, sf):
    from tessera.operators.edits import original_span, replace_spans
    d = docs(spark, sf)
    from tessera.operators.edits import apply_segments
    _, segs, _ = replace_spans(d, digit_ops(tokenize(d)))
    segs = materialize(segs, "segments")
    # documents are dealt once, for the join with their segments and for the new tokens and their spans
    nd = apply_segments(by_document(d), segs)
    nt = tokenize(nd, prepartitioned=True).select("doc_id", "tok_idx", "begin", "end")
    out = original_span(segs, nt, partitions=text_partitions(spark, d))
    cols = ["tok_idx", "begin", "end"] + [f"{p}_{m}" for p in ("begin", "end")
                                          for m in ("relaxed", "strict", "backward", "forward")]
    return bigint(out.select("doc_id", *cols), *cols)


# ----------------------------------------------------------- S13 / S2 / W1

@register("page_names", sql=f"""WITH {tokens_cte("(SELECT page_id, html FROM pages)", "page_id", "html")}
SELECT p.page_id, string_split(regexp_replace(p.url, '[?#].*$', ''), '/')[-1] AS name_full,
       regexp_replace(string_split(regexp_replace(p.url, '[?#].*$', ''), '/')[-1], '\\.[^.]*$', '') AS name_stem,
       CAST(count(t.tok_idx) AS BIGINT) AS n_tokens, CAST(count(t.word_idx) AS BIGINT) AS n_words
FROM pages p LEFT JOIN tokens t USING (page_id) GROUP BY p.page_id, p.url""")
def q_page_names(spark, sf):
    """Second corpus through ``from_table``: pack names from the URL path
    (S2 ``full`` and ``stem`` rules) and token counts of the raw page."""
    from tessera.functions.text import pack_name
    from tessera.sources.readers import from_table
    p = read_table(spark, sf, "pages").select("page_id", "url", "html")
    d = from_table(p, "page_id", "html")
    t = tokenize(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("word_idx").alias("n_words"))
    path = F.regexp_replace("url", r"[?#].*$", "")
    out = p.select(F.col("page_id").alias("doc_id"), pack_name(path, "full").alias("name_full"),
                   pack_name(path, "stem").alias("name_stem")).join(t, "doc_id", "left")
    return bigint(out.select(F.col("doc_id").alias("page_id"), "name_full", "name_stem",
                             F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                             F.coalesce("n_words", F.lit(0)).alias("n_words")), "n_tokens", "n_words")


def conversation_documents(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multi-part documents: one document per conversation, turns joined by
    ``\\n`` in turn order; turn spans from a running sum of lengths (W1).
    The window is per conversation (bounded by one conversation)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conv.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("begin", F.coalesce(F.sum(F.length("text") + 1).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    spans = t.select("conv_id", "turn", "role", "begin", (F.col("begin") + F.length("text")).cast("int").alias("end"))
    d = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                                          lambda x: x["text"]), "\n").alias("text"))
    return d, spans


@register("conversation_turns", sql=f"""WITH
c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, turn, role, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin, length(text) AS len FROM c),
d AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM c GROUP BY conv_id),
{tokens_cte("d", "conv_id", "text")}
SELECT s.conv_id, CAST(s.turn AS BIGINT) AS turn, s.role, s.begin, CAST(s.begin + s.len AS BIGINT) AS "end",
       CAST(count(t.tok_idx) AS BIGINT) AS n_tokens
FROM s LEFT JOIN tokens t ON t.conv_id = s.conv_id AND t.begin >= s.begin AND t."end" <= s.begin + s.len
GROUP BY s.conv_id, s.turn, s.role, s.begin, s.len""")
def q_conversation_turns(spark, sf):
    conv = read_table(spark, sf, "conversations")
    d, spans = conversation_documents(conv)
    tok = tokenize(d, key="conv_id")
    pairs = covered_by(spans.select("conv_id", "turn", F.col("begin").alias("o_begin"), F.col("end").alias("o_end")),
                       tok.select("conv_id", "tok_idx", F.col("begin").alias("i_begin"), F.col("end").alias("i_end")),
                       key="conv_id")
    n = pairs.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_tokens"))
    out = spans.join(n, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "begin", "end", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    return bigint(out, "turn", "begin", "end", "n_tokens")
