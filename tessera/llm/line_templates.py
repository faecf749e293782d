"""Line dedup by a log-template tree, in DataFrame expressions only.

A line is parsed down a tree of fixed depth: by its token count, then by its
leading tokens (a token with a digit is a variable field at once). In a leaf,
a token is constant where enough documents have it at its place and variable
(``<*>``) elsewhere; that gives each line a template. Templates that recur
across documents are boilerplate and their lines are dropped, whatever share
of a document they are. Copies of one document are no recurrence and count as
one: those equal in their set of lines, or as a table of classes says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS, packed, unpacked
from tessera.plans.util import materialize

FIELD = "<*>"
#: A token with a digit. The look-behind and the possessive runs keep the
#: match linear in the line, however long a token is.
DIGITS = rf"(?<![^{WS}])[^{WS}0-9]*+[0-9][^{WS}]*+"


def _trimmed(line):
    return F.trim(line, F.lit(" \t\x0b\x0c\r"))


def _tokens(line):
    """Tokens of a trimmed line; most lines hold no digit and skip the mask."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGITS, FIELD)).otherwise(line)
    return F.split(masked, rf"[{WS}]+")


def _line_set(text):
    """A hash of the set of a text's lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != "")
    return F.xxhash64(F.sort_array(F.array_distinct(lines)))


def _lines(docs: DataFrame, lead: int) -> DataFrame:
    """Slim rows, one per line with a token: whose it is, where, its token
    count, leaf and identity. No text leaves the scan."""
    own = [c for c in docs.columns if c != "text"]
    rows = docs.select(*own, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.select(*own, "line_no", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    # tokens bound once: a filter on them would be pushed down and split the line again
    rows = rows.select(*own, "line_no", F.transform(F.array(_tokens(F.col("line"))), lambda t: F.struct(
        F.size(t).alias("n"), F.xxhash64(F.size(t), F.slice(t, 1, lead)).alias("leaf"), F.xxhash64(t).alias("line")))[0].alias("x"))
    return rows.select(*own, "line_no", F.col("x.n").alias("n_tokens"), F.col("x.leaf").alias("leaf"),
                       F.col("x.line").alias("line"))


def drop_recurring(docs: DataFrame, min_docs: int = 3, lead: int = 3, min_tokens: int = 1, constant_share: float = 0.6,
                   copies: DataFrame | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ...) without the lines whose template
    occurs in at least ``min_docs`` documents; adds ``n_lines_dropped``.

    A template counts if at least ``constant_share`` of its tokens are
    constant; lines of fewer than ``min_tokens`` tokens never count. Copies
    count as one document: those of one ``class`` in ``copies`` (``text_hash``:
    ``xxhash64`` of the text, once each; ``class``), where it names them, else
    those equal in their set of lines. Null text stays null, an empty text empty; a null ``doc_id`` is an
    id like others; rows equal in ``doc_id`` and ``text`` count as one
    document and all get the same result; an empty table gives no rows; other
    columns pass through, an input ``n_lines_dropped`` is replaced.

    Only hashes and counts are shuffled for the tree; texts move in two joins
    on the document (one to read a specimen of each line of a leaf that may
    recur, one to rewrite). Equal lines are counted before tokens are looked
    at, so groups of copies cost one row a line.
    """
    texts = docs.select(F.xxhash64("doc_id", "text").alias("_d"), "doc_id", "text")
    owned = texts.select("*", F.xxhash64("text").alias("_t"), _line_set(F.col("text")).alias("_c"))
    lines = _lines(owned, lead)
    if copies is not None:
        named = copies.select(F.col("text_hash").alias("_u"), F.xxhash64(F.lit("class"), "class").alias("_class"))
        lines = lines.join(named, F.col("_t") == F.col("_u"), "left").withColumn("_c", F.coalesce("_class", "_c")).drop("_u", "_class")
    lines = materialize(lines.drop("_t"), "line-leaves")
    one = ["_c"]  # what counts as one document
    long_lines = lines.where(F.col("n_tokens") >= min_tokens)
    distinct = (long_lines.groupBy("leaf", "line", *one).agg(F.min(F.struct("_d", "doc_id", "line_no")).alias("at"))
                .groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("at").alias("at")))
    distinct = materialize(distinct, "distinct-lines")
    live = distinct.groupBy("leaf").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    live = distinct.join(live, "leaf", "left_semi")
    # a specimen of each line in a leaf that may hold a recurring template
    wanted = live.select("leaf", "line", "n_docs", "at.*").groupBy("_d", "doc_id").agg(
        F.collect_list(F.struct("leaf", "line", "n_docs", "line_no")).alias("wanted"))
    same_doc = F.expr("a._d = b._d and a.doc_id <=> b.doc_id")
    specimens = (texts.alias("a").join(wanted.alias("b"), same_doc)
                 .select(F.split("a.text", "\n").alias("parts"), F.explode("b.wanted").alias("w"))
                 .select("w.leaf", "w.line", "w.n_docs", _trimmed(F.expr("parts[w.line_no]")).alias("l"))
                 .select("leaf", "line", "n_docs", _tokens(F.col("l")).alias("tokens")))
    specimens = materialize(specimens.dropDuplicates(["leaf", "line"]), "line-specimens")
    tokens = specimens.select("leaf", "line", "n_docs", F.posexplode("tokens").alias("place", "token"))
    constant = (tokens.where(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("n_docs").alias("n"))
                .where(F.col("n") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("constant")))
    templates = (tokens.join(constant, ["leaf", "place", "token"], "left")
                 .groupBy("leaf", "line").agg(
                     F.count("constant").alias("n_constant"), F.count(F.lit(1)).alias("n_tokens"),
                     F.xxhash64(F.sort_array(F.collect_list(F.struct(
                         "place", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(FIELD)).alias("token"))))).alias("template"))
                 .where(F.col("n_constant") >= F.col("n_tokens") * constant_share).select("leaf", "line", "template"))
    hits = materialize(long_lines.join(templates, ["leaf", "line"]), "template-lines")
    recurring = (hits.select("leaf", "template", *one).distinct().groupBy("leaf", "template")
                 .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf", "template"))
    drops = (hits.join(recurring, ["leaf", "template"], "left_semi").select("_d", "doc_id", "line_no", "n_tokens").distinct()
             .groupBy("_d", "doc_id").agg(F.collect_list("line_no").alias("_drop")))
    drops = drops.select(F.col("_d").alias("_e"), F.col("doc_id").alias("_id"), "_drop")
    rows = packed(docs).select("_row", F.xxhash64("_row.doc_id", "_row.text").alias("_d"))
    out = rows.join(drops, F.expr("_d = _e and _row.doc_id <=> _id"), "left")
    rest = F.expr(r"""transform(array(split(_row.text, '\n')), p ->
        array_join(transform(array_except(sequence(0, size(p) - 1), _drop), i -> p[i]), '\n'))[0]""")
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")
    return out.select(*unpacked(docs.columns, {
        "text": F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(rest), "n_lines_dropped": dropped}))


#: DuckDB: the same on whole strings. RE2 has no look-behind; masking token by token is the same.
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, text, i - 1 AS line_no, array_to_string(list_sort(list_distinct(list_filter(
           list_transform(parts, lambda p: trim(p, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda p: p <> ''))), chr(10)) AS copy,
         list_transform(list_filter(regexp_split_to_array(parts[i], '[\x20\x09-\x0D]+'), lambda x: x <> ''),
                        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens
  FROM (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS parts FROM documents) d,
       unnest(range(1, len(parts) + 1)) AS r(i)),
k AS (SELECT doc_id, text, copy, line_no, tokens, len(tokens) AS n FROM l WHERE len(tokens) > 0),
d AS (SELECT tokens, n, tokens[1:3] AS leaf, count(DISTINCT copy) AS n_docs FROM k GROUP BY ALL),
t AS (SELECT tokens, n, leaf, n_docs, place, tokens[place] AS token FROM d, unnest(range(1, n + 1)) AS r(place)),
c AS (SELECT n, leaf, place, token FROM t WHERE token <> '<*>' GROUP BY ALL HAVING sum(n_docs) >= 3),
p AS (SELECT t.tokens, t.n, t.leaf, string_agg(CASE WHEN c.place IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.place) AS template,
             count(c.place) AS n_constant
      FROM t LEFT JOIN c ON t.n = c.n AND t.leaf = c.leaf AND t.place = c.place AND t.token = c.token GROUP BY ALL),
h AS (SELECT k.doc_id, k.text, k.copy, k.line_no, k.n, p.leaf, p.template FROM k JOIN p ON k.tokens = p.tokens
      WHERE p.n_constant >= p.n * 0.6),
r AS (SELECT n, leaf, template FROM h GROUP BY ALL HAVING count(DISTINCT copy) >= 3),
y AS (SELECT h.doc_id, h.text, list(h.line_no) AS gone
      FROM h JOIN r ON h.n = r.n AND h.leaf = r.leaf AND h.template = r.template GROUP BY ALL)
SELECT o.doc_id, CASE WHEN y.gone IS NULL THEN o.text ELSE array_to_string(
         list_transform(list_filter(range(0, len(string_split(o.text, chr(10)))), lambda i: NOT list_contains(y.gone, i)),
                        lambda i: string_split(o.text, chr(10))[i + 1]), chr(10)) END AS text,
       coalesce(len(y.gone), 0)::BIGINT AS n_lines_dropped
FROM documents o LEFT JOIN y ON o.text = y.text AND o.doc_id IS NOT DISTINCT FROM y.doc_id
"""
