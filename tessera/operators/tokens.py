"""Tokens and sentences with character offsets (A1, A2, A3).

Plan shape: the documents are hash-partitioned on the key once, before the
regex explode, so every later window (offsets, word ordinals, sentence
ordinals) and the per-document aggregates reuse that one exchange instead of
shuffling the (much larger) exploded token rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spans import anti_points_in_spans
from tessera.util import text_partitions

# Token and sentence rules.
# A piece is optional leading whitespace followed by one token; a token is a
# run of letters/digits or one other non-space character.
TOKEN_PIECE = r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"
WORD_START = r"^[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}]+"
SENTENCE_TERMINALS = [".", "?", "!"]
SENTENCE_CLOSERS = ['"', "'", ")", "]", "}", "»", "”", "’"]


def by_document(docs: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Hash-partition documents on ``key`` (the single exchange that all
    per-document windows and aggregates downstream reuse)."""
    return docs.repartition(text_partitions(docs.sparkSession, docs), *as_list(key))


def as_list(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def tokenize(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text",
             prepartitioned: bool = False) -> DataFrame:
    """Token spans of every document (A1).

    Output: ``key, tok_idx, begin, end, token, word_idx`` where ``word_idx``
    is the ordinal among letter/digit tokens (null for punctuation).
    """
    keys = as_list(key)
    d = docs.select(*keys, text)
    if not prepartitioned:
        d = by_document(d, key)
    # tokens then come in the order of the windows, whose sorts find one run
    pieces = d.sortWithinPartitions(*keys).select(
        *keys,
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN_PIECE), 0))
        .alias("tok_idx", "piece"),
    )
    # the white space that the pieces' \s takes
    bare = F.ltrim("piece", F.lit(" \t\n\x0b\x0c\r"))
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tok = (
        pieces.withColumn("token", bare)
        .withColumn("_lead", F.length("piece") - F.length("token"))
        # a token of several characters is a run of letters and digits
        .withColumn("_w", ((F.length("token") > 1) | F.col("token").rlike(WORD_START)).cast("int"))
        .withColumn("_start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
        .withColumn("_nw", F.sum("_w").over(upto))
    )
    return tok.select(
        *keys,
        F.col("tok_idx").cast("int").alias("tok_idx"),
        (F.col("_start") + F.col("_lead")).cast("int").alias("begin"),
        (F.col("_start") + F.length("piece")).cast("int").alias("end"),
        "token",
        F.when(F.col("_w") == 1, F.col("_nw") - 1).cast("int").alias("word_idx"),
    )


def document_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of A1 without offsets, one row per document: ``key, words``
    (lower-cased, in the order of ``word_idx``). A word is a whole run of
    letters and digits, so no window has to count tokens. Documents of one
    key are one, their tokens merged by ``tok_idx`` as in :func:`tokenize`."""
    per = by_document(docs.select(key, text), key).groupBy(key).agg(F.collect_list(text).alias("_texts"))
    runs = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    pieces = lambda t: F.transform(F.regexp_extract_all(t, F.lit(TOKEN_PIECE), F.lit(0)), lambda p, i: F.struct(
        i.alias("i"), F.ltrim(p, F.lit(" \t\n\x0b\x0c\r")).alias("t")))
    merged = F.transform(F.filter(F.array_sort(F.flatten(F.transform("_texts", pieces))), lambda x: x["t"].rlike(WORD_START)), lambda x: x["t"])
    words = F.when(F.size("_texts") == 1, runs(F.col("_texts")[0])).when(F.size("_texts") > 1, merged).otherwise(
        F.array().cast("array<string>"))
    return per.select(key, F.transform(words, F.lower).alias("words"))


def sentence_ends(tokens: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Tokens with ``is_end``: the token closes a sentence (A2 rule).

    A terminal ``. ? !`` (or one closing quote/bracket glued to a terminal)
    ends a sentence when the next token starts after a gap; the last token of
    a document always ends one.
    """
    w = Window.partitionBy(*as_list(key)).orderBy("tok_idx")
    nxt_begin = F.lead("begin").over(w)
    prv_tok = F.lag("token").over(w)
    prv_end = F.lag("end").over(w)
    gap_after = nxt_begin.isNull() | (nxt_begin > F.col("end"))
    terminal = F.col("token").isin(SENTENCE_TERMINALS)
    closer = (F.col("token").isin(SENTENCE_CLOSERS) & prv_tok.isin(SENTENCE_TERMINALS)
              & (prv_end == F.col("begin")))
    return tokens.withColumn(
        "is_end", (nxt_begin.isNull() | (gap_after & (terminal | closer))).cast("int"))


def with_sentence_idx(tokens: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Tokens with ``sent_idx`` (running count of sentence ends before)."""
    w = Window.partitionBy(*as_list(key)).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    t = sentence_ends(tokens, key)
    return t.withColumn("sent_idx", F.coalesce(F.sum("is_end").over(w), F.lit(0)).cast("int"))


def split_sentences(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence spans ``key, sent_idx, begin, end, n_tokens`` (A2). Tokens that
    carry their ``sent_idx`` are grouped as they are."""
    t = tokens if "sent_idx" in tokens.columns else with_sentence_idx(tokens, key)
    return t.groupBy(key, "sent_idx").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.count(F.lit(1)).cast("int").alias("n_tokens"))


def split_sentences_cautious(tokens: DataFrame, mentions: DataFrame,
                             key: str = "doc_id", bin_size: int = 1024) -> DataFrame:
    """A2 boundaries, minus those that fall inside a mention (A3).

    A boundary ``e`` is dropped when some mention has ``begin <= e < end``;
    the next sentence then starts at the last kept end + 1 (first at 0).
    Output: ``key, sent_idx, begin, end``.
    """
    ends = split_sentences(tokens, key).select(key, F.col("end").alias("pos"))
    kept = anti_points_in_spans(ends, mentions.select(key, "begin", "end"), key=key,
                                point="pos", bin_size=bin_size)
    w = Window.partitionBy(key).orderBy("pos")
    return kept.select(
        key,
        (F.row_number().over(w) - 1).cast("int").alias("sent_idx"),
        F.coalesce(F.lag("pos").over(w) + 1, F.lit(0)).cast("int").alias("begin"),
        F.col("pos").cast("int").alias("end"),
    )
