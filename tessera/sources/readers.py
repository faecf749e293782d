"""Corpus readers.

Every reader is a *scan* (files -> rows with the file name) and a *parser*
(rows -> documents and annotations). Parsers take DataFrames, so the same
code runs on files, on tables and on streams. Each parser works inside one
record (one document, or one file of a document); nothing is ordered across
files, so parallelism is per record.

Output shapes: ``documents(doc_id, pack_name, source, text)`` and
annotation rows ``doc_id, type, begin, end, surface, ...attributes``.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_digits, pack_name, py_split, py_strip, span_text
from tessera.util import text_partitions

# Format markers.
DOC_BREAK = "-DOCSTART-"
NEWS_SKIP_PREFIX = "--"
LINK_MISSING = "--NME--"
LINK_SUFFIX = ".link.tsv"
CUI_LESS = "cui_less"
PAPER_DELIMITER = "\n\n"


# ---------------------------------------------------------------- scans

def list_corpus(spark: SparkSession, path: str, ext: str, recursive: bool = True,
                binary: bool = False) -> DataFrame:
    """Files under ``path`` with extension ``ext``: ``file, content`` (one row
    per file; S1). ``binary`` keeps raw bytes (for lenient decoding)."""
    glob = "*" + (ext if ext.startswith(".") else "." + ext)
    if binary:
        r = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(path))
        return r.select(F.col("path").alias("file"), F.col("content"))
    r = (spark.read.option("pathGlobFilter", glob)
         .option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True))
    return r.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def scan_records(spark: SparkSession, path: str, ext: str, sep: str = "\n\n") -> DataFrame:
    """Splittable scan of files whose records are separated by ``sep``:
    ``file, record`` (no record spans two rows)."""
    glob = "*" + (ext if ext.startswith(".") else "." + ext)
    r = (spark.read.option("lineSep", sep).option("pathGlobFilter", glob)
         .option("recursiveFileLookup", "true").text(path))
    return r.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))


def decode_lenient(content_col) -> "F.Column":
    """UTF-8 decode dropping undecodable bytes (they become U+FFFD in the
    cast, which is then removed)."""
    return F.regexp_replace(F.col(content_col).cast("string"), "�", "")


def _lines(col):
    return F.split(col, "\r\n|\r|\n")


# ------------------------------------------------------------- news

def parse_news(files: DataFrame, file_col: str = "file", content_col: str = "content") -> DataFrame:
    """Per line: strip; drop empty lines and lines starting ``--``; join
    with ``\\n`` (S5). ``pack_name`` = basename with extension."""
    kept = F.filter(F.transform(_lines(F.col(content_col)), lambda x: py_strip(x)),
                    lambda x: (x != "") & ~x.startswith(NEWS_SKIP_PREFIX))
    return files.select(pack_name(F.col(file_col), "full").alias("pack_name"),
                        F.col(file_col).alias("file"),
                        F.array_join(kept, "\n").alias("text"))


def read_news(spark: SparkSession, path: str, ext: str = ".txt") -> DataFrame:
    files = list_corpus(spark, path, ext, binary=True)
    return parse_news(files.select("file", decode_lenient("content").alias("content")))


def read_subdirs(spark: SparkSession, root: str, ext: str = ".txt") -> DataFrame:
    """News reader over every sub-directory at any depth, each file once;
    files directly in ``root`` are not read (S12). ``source`` = parent dir."""
    files = list_corpus(spark, root, ext, binary=True)
    rootp = root.rstrip("/")
    rel = F.regexp_replace(F.col("file"), "^.*?" + re.escape(rootp) + "/", "")
    files = files.where(F.size(F.split(rel, "/")) >= 2)
    out = parse_news(files.select("file", decode_lenient("content").alias("content")))
    return out.withColumn("source", F.element_at(F.split("file", "/"), -2))


# ------------------------------------------------------------ papers

PAPER_SCHEMA = ("paper_id STRING, metadata STRUCT<title: STRING>, "
                "abstract ARRAY<STRUCT<text: STRING>>, body_text ARRAY<STRUCT<text: STRING>>")


def section_spans(title, abstract, body, delimiter: str = PAPER_DELIMITER):
    """Offsets of the three parts joined by ``delimiter`` (P7): returns
    ``(text, [(type, begin, end), ...])`` column expressions."""
    d = len(delimiter)
    lt, la = F.length(title), F.length(abstract)
    text = F.concat_ws(delimiter, title, abstract, body)
    spans = [("Title", F.lit(0), lt), ("Abstract", lt + d, lt + d + la),
             ("Body", lt + 2 * d + la, F.length(text))]
    return text, spans


def parse_papers(papers: DataFrame, file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """Paper JSON rows (``PAPER_SCHEMA`` + file) -> documents and
    Document/Title/Abstract/Body spans (S3). Entry texts are concatenated
    with no separator; an empty abstract gives a zero-length span."""
    parts = papers.select(
        pack_name(F.col(file_col), "stem").alias("pack_name"), F.col("paper_id"),
        F.coalesce(F.col("metadata.title"), F.lit("")).alias("_t"),
        F.coalesce(F.array_join(F.col("abstract.text"), ""), F.lit("")).alias("_a"),
        F.coalesce(F.array_join(F.col("body_text.text"), ""), F.lit("")).alias("_b"))
    text, spans = section_spans(F.col("_t"), F.col("_a"), F.col("_b"))
    docs = parts.select("pack_name", "paper_id", text.alias("text"), "_t", "_a", "_b")
    st = F.array(*[F.struct(F.lit(t).alias("type"), b.cast("int").alias("begin"),
                            e.cast("int").alias("end")) for t, b, e in spans],
                 F.struct(F.lit("Document").alias("type"), F.lit(0).alias("begin"),
                          F.length(text).cast("int").alias("end")))
    anns = (docs.select("pack_name", "text", F.inline(st))
            .select("pack_name", "type", "begin", "end",
                    span_text("text", "begin", "end").alias("surface")))
    return docs.drop("_t", "_a", "_b"), anns


def read_conll(spark: SparkSession, path: str, ext: str = ".conll",
               column_format=("word", None, None, "entity_label"), doc_break: str | None = DOC_BREAK,
               n_sent_per_doc: int = 0) -> DataFrame:
    """Column files on disk -> units (S7), scanned line by line in splits
    for both layouts."""
    return conll_units(scan_lines(spark, path, ext), column_format, doc_break,
                       0 if doc_break else n_sent_per_doc, lines_given=True)


def read_papers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paper JSON files -> documents, spans, quarantine: a file that is no
    JSON object of the schema becomes a quarantine row, not an empty document."""
    rows = (spark.read.schema(PAPER_SCHEMA + ", _broken STRING").option("multiLine", "true")
            .option("columnNameOfCorruptRecord", "_broken")
            .option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
            .withColumn("file", F.col("_metadata.file_path")))
    empty = F.col("paper_id").isNull() & F.col("metadata").isNull() & F.col("abstract").isNull() & F.col("body_text").isNull()
    good, bad = split_bad_records(rows, {"not valid JSON": F.col("_broken").isNotNull(), "no paper fields": empty},
                                  record_col="_broken")
    docs, anns = parse_papers(good.drop("_broken"))
    return docs, anns, bad


# --------------------------------------------------------- stand-off

def parse_standoff(txt: DataFrame, ann: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``.txt`` rows (``name, text``) + ``.ann`` rows (``name, content``) ->
    documents, mentions, quarantine (S4, S9, J4).

    ``T<id> TYPE begin end surface`` makes a mention; ``N<id> Reference
    T<id> UMLS:<cui>`` attaches a link to the *latest preceding* T line and
    only if it names it; ``cui_less`` gives a null link; the last such N line
    wins. Lines with < 4 fields or a non-numeric id are skipped; bad
    offsets and N lines without ``UMLS:`` go to quarantine (the file is kept).
    A document without an ``.ann`` has zero mentions.
    """
    docs = txt.select(F.col("name").alias("pack_name"), "text")
    lines = ann.select("name", F.posexplode(_lines(F.col("content"))).alias("line_no", "line"))
    lines = lines.withColumn("parts", py_split(F.col("line")))
    p0 = F.element_at("parts", 1)
    valid = (F.size("parts") >= 4) & is_digits(F.expr("substring(element_at(parts, 1), 2)"))
    lines = lines.where(valid)
    is_t = F.col("line").startswith("T")
    is_n = F.col("line").startswith("N")
    w = Window.partitionBy("name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("cur_t", F.last(F.when(is_t, p0), ignorenulls=True).over(w))
    t = lines.where(is_t).select(
        "name", "line_no", F.col("cur_t").alias("t_id"), F.element_at("parts", 2).alias("ner_type"),
        F.element_at("parts", 3).try_cast("int").alias("begin"),
        F.element_at("parts", 4).try_cast("int").alias("end"), "line")
    bad_t = t.where(F.col("begin").isNull() | F.col("end").isNull()).select(
        F.col("name").alias("file"), F.col("line").alias("record"), F.lit("bad offsets").alias("reason"))
    t = t.where(F.col("begin").isNotNull() & F.col("end").isNotNull())
    n = lines.where(is_n & (F.element_at("parts", 3) == F.col("cur_t")))
    bad_n = n.where(~F.element_at("parts", 4).contains("UMLS:")).select(
        F.col("name").alias("file"), F.col("line").alias("record"), F.lit("no UMLS: link").alias("reason"))
    n = n.where(F.element_at("parts", 4).contains("UMLS:"))
    link = F.when(F.element_at("parts", 4).contains(CUI_LESS), F.lit(None)).otherwise(F.element_at("parts", 4))
    nl = (n.select("name", F.col("cur_t").alias("t_id"), "line_no", link.alias("umls_link"))
          .groupBy("name", "t_id").agg(F.max_by("umls_link", "line_no").alias("umls_link"),
                                       F.max("line_no").alias("_n_line")))
    # A T id may repeat in a file: an N line belongs to the latest T before it.
    tl = t.withColumn("_next_t", F.lead("line_no").over(
        Window.partitionBy("name", "t_id").orderBy("line_no")))
    m = tl.join(nl, ["name", "t_id"], "left").withColumn(
        "umls_link", F.when((F.col("_n_line") > F.col("line_no"))
                            & (F.col("_next_t").isNull() | (F.col("_n_line") < F.col("_next_t"))),
                            F.col("umls_link")))
    m = m.join(docs.withColumnRenamed("pack_name", "name"), "name").select(
        F.col("name").alias("pack_name"), F.lit("MedicalEntityMention").alias("type"), "begin", "end",
        span_text("text", "begin", "end").alias("surface"), "ner_type", "umls_link", "t_id")
    return docs, m, bad_t.unionByName(bad_n)


def path_stem(file):
    """A file's path without its extension."""
    return F.regexp_replace(file, r"\.[^./]*$", "")


def read_standoff(spark: SparkSession, path: str):
    """Stand-off files: a ``.txt`` goes with the ``.ann`` of the same path.
    ``path`` (without extension) is the key of all three results, so equal
    names in several folders stay apart; ``pack_name`` is the bare name."""
    txt = list_corpus(spark, path, ".txt").select(path_stem(F.col("file")).alias("name"), F.col("content").alias("text"))
    ann = list_corpus(spark, path, ".ann").select(path_stem(F.col("file")).alias("name"), "content")
    docs, mentions, bad = parse_standoff(txt, ann)
    named = lambda df: df.withColumnRenamed("pack_name", "path").withColumn(
        "pack_name", pack_name(F.col("path"), "full"))
    return named(docs), named(mentions), bad


def document_spans(docs: DataFrame, key: str = "pack_name") -> DataFrame:
    """One ``Document`` span per document: ``key, type, begin, end``."""
    return docs.select(key, F.lit("Document").alias("type"), F.lit(0).alias("begin"),
                       F.length("text").cast("int").alias("end"))


# ---------------------------------------------------------- pubtator

def parse_pubtator(records: DataFrame, file_col: str = "file") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One record per document (blank-line separated): ``PMID|t|title``,
    ``PMID|a|abstract``, 6-tab-column mention lines (S6). Text = title +
    ``\\n`` + abstract + ``\\n``; ``ner_type`` = the semantic-type field as
    one string; ``umls_link = 'UMLS:' + id``. Lines with another number of
    tab columns are ignored (reported in quarantine with offsets that do
    not parse)."""
    ls = records.select(file_col, F.filter(_lines(F.col("record")), lambda x: x != "").alias("ls"))
    ta = F.filter("ls", lambda x: x.contains("|t|") | x.contains("|a|"))
    part = lambda x: F.array_join(F.slice(F.split(x, r"\|"), 3, F.greatest(F.size(F.split(x, r"\|")) - 2, F.lit(0))), "|")
    text = F.array_join(F.transform(ta, lambda x: F.concat(part(x), F.lit("\n"))), "")
    docs = (ls.where(F.size(ta) > 0)
            .select(file_col, F.element_at(F.split(F.element_at(ta, 1), r"\|"), 1).alias("pack_name"),
                    text.alias("text"), "ls"))
    ml = docs.select(file_col, "pack_name", "text", F.posexplode(
        F.filter("ls", lambda x: (F.size(F.split(x, "\t")) == 6) & ~(x.contains("|t|") | x.contains("|a|"))))
        .alias("line_no", "line"))
    f = F.split("line", "\t")
    ml = ml.select(file_col, "pack_name", "text", "line",
                   F.element_at(f, 2).try_cast("int").alias("begin"),
                   F.element_at(f, 3).try_cast("int").alias("end"),
                   F.element_at(f, 5).alias("ner_type"),
                   F.concat(F.lit("UMLS:"), F.element_at(f, 6)).alias("umls_link"))
    bad = ml.where(F.col("begin").isNull() | F.col("end").isNull()).select(
        F.col(file_col).alias("file"), F.col("line").alias("record"), F.lit("bad offsets").alias("reason"))
    mentions = ml.where(F.col("begin").isNotNull() & F.col("end").isNotNull()).select(
        "pack_name", F.lit("MedicalEntityMention").alias("type"), "begin", "end",
        span_text("text", "begin", "end").alias("surface"), "ner_type", "umls_link")
    return docs.drop("ls"), mentions, bad


def read_pubtator(spark: SparkSession, path: str, ext: str = ".txt"):
    """Files of blank-line separated records, read line by line in splits
    (any line ending); a record is put together from its own lines."""
    lines = scan_lines(spark, path, ext)
    rows = _count_marks(lines, py_strip("line") == "").withColumnRenamed("_ord", "record_no")
    records = rows.groupBy("file", "record_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "pos", "line"))), lambda x: x["line"]), "\n").alias("record"))
    return parse_pubtator(records)


# ------------------------------------------------------------ CoNLL

KNOWN_COLUMNS = {"word", "pos", "chunk", "entity_label"}


def check_conll_args(column_format, doc_break, n_sent_per_doc):
    """Argument check when the job is defined."""
    named = [c for c in column_format if c is not None]
    unknown = set(named) - KNOWN_COLUMNS
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    if len(named) != len(set(named)):
        raise ValueError("duplicate columns in column_format")
    for need in ("word", "entity_label"):
        if need not in named:
            raise ValueError(f"column_format lacks {need!r}")
    if not doc_break and not (n_sent_per_doc and n_sent_per_doc > 0):
        raise ValueError("give doc_break or n_sent_per_doc > 0")


def scan_lines(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """Splittable line scan keeping order: ``file, block, pos, line`` where
    ``block`` is the byte offset of the input split and ``pos`` increases
    with the line's position inside the split."""
    glob = "*" + (ext if ext.startswith(".") else "." + ext)
    r = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path))
    return r.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def content_lines(files: DataFrame, file_col: str = "file", content_col: str = "content") -> DataFrame:
    """In-memory file contents as ``file, block, pos, line`` (one block)."""
    return files.select(F.col(file_col).alias("file"), F.lit(0).cast("long").alias("block"),
                        F.posexplode(_lines(F.col(content_col))).alias("pos", "line"))


def _count_marks(lines: DataFrame, mark) -> DataFrame:
    """Lines that are no mark, with ``_ord`` = the number of marks before
    them in their file. Counted per split (a window over one split), then
    offset by the marks of earlier splits of the same file (one row per
    split): no window ever spans a whole file."""
    wb = Window.partitionBy("file", "block").orderBy("pos")
    marked = lines.withColumn("_m", mark.cast("int"))
    inside = marked.withColumn("_in", F.sum("_m").over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = marked.groupBy("file", "block").agg(F.sum("_m").alias("_n"))
    wf = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.coalesce(F.sum("_n").over(wf), F.lit(0))).select("file", "block", "_off")
    out = inside.join(offs, ["file", "block"])
    return out.where(F.col("_m") == 0).select("file", "block", "pos", "line",
                                              (F.col("_off") + F.col("_in")).cast("int").alias("_ord"))


def number_documents(lines: DataFrame, doc_break: str) -> DataFrame:
    """``doc_ord`` for every line = number of ``doc_break`` lines at or
    before it in its file. Marker lines are dropped."""
    return _count_marks(lines, F.col("line").contains(doc_break)).withColumnRenamed("_ord", "doc_ord")


def number_sentences(lines: DataFrame) -> DataFrame:
    """0-based ``sent_ord`` for every token line of a column file: a token
    line starts a sentence when the previous non-comment line is blank (or
    it is the first). Starts are counted per split; the first line of a
    split is fixed up from the previous split's last non-comment line, and
    counts are offset by earlier splits (one row per split) — no window
    spans a whole file. Blank and comment lines are dropped."""
    ln = lines.withColumn("_s", py_strip("line")).where(~F.col("_s").startswith("#"))
    ln = ln.withColumn("_blank", F.col("_s") == "")
    wb = Window.partitionBy("file", "block").orderBy("pos")
    ln = ln.withColumn("_prev_blank", F.lag("_blank").over(wb))
    per = ln.groupBy("file", "block").agg(
        F.max_by("_blank", "pos").alias("_last_blank"),
        F.sum((~F.col("_blank") & F.coalesce(F.col("_prev_blank"), F.lit(False))).cast("int")).alias("_inner"),
        F.min_by(~F.col("_blank"), "pos").alias("_first_tok"))
    wf = Window.partitionBy("file").orderBy("block")
    prev_last = F.lag("_last_blank").over(wf)
    # first line of a split starts a sentence if it is a token line and the
    # previous split ended blank (or there is none)
    per = per.withColumn("_first_start", (F.col("_first_tok") & F.coalesce(prev_last, F.lit(True))).cast("int"))
    per = per.withColumn("_n", F.col("_inner") + F.col("_first_start"))
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(wf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ln = ln.join(per.select("file", "block", "_first_start", "_off"), ["file", "block"])
    start = (~F.col("_blank") & F.when(F.col("_prev_blank").isNull(), F.col("_first_start") == 1)
             .otherwise(F.col("_prev_blank")))
    ln = ln.withColumn("_st", start.cast("int"))
    ln = ln.withColumn("sent_ord", F.col("_off") + F.sum("_st").over(
        wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return ln.where(~F.col("_blank")).select("file", "block", "pos", "line", F.col("sent_ord").cast("long"))


def conll_units(files: DataFrame, column_format=("word", None, None, "entity_label"),
                doc_break: str | None = DOC_BREAK, n_sent_per_doc: int = 0,
                file_col: str = "file", content_col: str = "content", lines_given: bool = False,
                prepartitioned: bool = False) -> DataFrame:
    """Column-format files -> one row per word:
    ``file, doc_ord, sent_ord, tok_idx, begin, end, word, label, pos``.

    Documents are split at lines containing ``doc_break`` or every
    ``n_sent_per_doc`` sentences; blank lines end sentences; ``#`` lines are
    comments. ``begin`` = sum of previous word lengths + 1 each (W1); all
    windows are per document. With ``lines_given`` the input is already
    ``file, block, pos, line`` (see :func:`scan_lines`): a huge file is then
    read in parallel splits in the marker layout. ``prepartitioned``: files
    given as one row each are hash-partitioned on ``file_col`` already.
    """
    check_conll_args(column_format, doc_break, n_sent_per_doc)
    cf = list(column_format)
    i_word, i_label = cf.index("word") + 1, cf.index("entity_label") + 1
    i_pos = cf.index("pos") + 1 if "pos" in cf else None

    def field(parts, i):
        return F.when(F.size(parts) >= i, F.element_at(parts, i))

    if doc_break and not lines_given:
        return _content_units(files, doc_break, i_word, i_label, i_pos, file_col, content_col, prepartitioned)
    if doc_break:
        rows = number_documents(files, doc_break)
        rows = rows.withColumn("line", py_strip("line"))
        w = Window.partitionBy("file", "doc_ord").orderBy("block", "pos")
        rows = rows.withColumn("sent_ord", F.sum((F.col("line") == "").cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("line_no", F.row_number().over(w)).drop("block", "pos")
        if file_col != "file":
            rows = rows.withColumnRenamed("file", file_col)
    else:
        lines_df = files if lines_given else content_lines(files, file_col, content_col)
        rows = number_sentences(lines_df)
        rows = rows.withColumn("doc_ord", F.floor(F.col("sent_ord") / n_sent_per_doc).cast("int"))
        rows = rows.withColumn("line", py_strip("line"))
        w = Window.partitionBy("file", "doc_ord").orderBy("block", "pos")
        rows = rows.withColumn("line_no", F.row_number().over(w)).drop("block", "pos")
        if file_col != "file":
            rows = rows.withColumnRenamed("file", file_col)
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = py_split(F.col("line"))
    rows = rows.select(file_col, "doc_ord", "sent_ord", "line_no",
                       F.element_at(parts, i_word).alias("word"),
                       field(parts, i_label).alias("label"),
                       (field(parts, i_pos) if i_pos else F.lit(None).cast("string")).alias("pos"))
    w = Window.partitionBy(file_col, "doc_ord").orderBy("line_no")
    rows = rows.withColumn("tok_idx", (F.row_number().over(w) - 1).cast("int"))
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.length("word") + 1).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return rows.select(file_col, "doc_ord", "sent_ord", "tok_idx", "begin",
                       (F.col("begin") + F.length("word")).cast("int").alias("end"), "word", "label", "pos")


_UNIT = pa.struct([("doc_ord", pa.int32()), ("sent_ord", pa.int64()), ("tok_idx", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()),
                   ("word", pa.string()), ("label", pa.string()), ("pos", pa.string())])
#: Different lines whose fields are kept for when they come again.
KEPT_LINES = 50_000


def _units_of(contents: pa.Array, doc_break: str, i_word: int, i_label: int, i_pos: int | None) -> pa.Array:
    """The units of each file (a list of its contents: the lines of several
    are taken in turn) in the marker layout, numbered as they are read."""
    out: list[list] = [[] for _ in _UNIT]
    put = [c.append for c in out]
    known: dict = {}
    ends = [0]
    for texts in contents:
        lines = [t.as_py().replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in texts.values]
        if len(lines) > 1:
            rows = (x for at in itertools.zip_longest(*lines) for x in at if x is not None)
        else:
            rows = lines[0] if lines else ()
        doc = sent = unit = begin = 0
        for raw in rows:
            found = known.get(raw)
            if found is None:
                line = raw.strip()
                if doc_break in raw:
                    found = "mark"
                elif not line:
                    found = "blank"
                elif line.startswith("#"):
                    found = "comment"
                else:
                    parts = line.split()
                    found = (parts[i_word], parts[i_label] if i_label < len(parts) else None,
                             parts[i_pos] if i_pos is not None and i_pos < len(parts) else None, len(parts[i_word]))
                if len(known) < KEPT_LINES:
                    known[raw] = found
            if found.__class__ is str:
                if found == "mark":
                    doc, sent, unit, begin = doc + 1, 0, 0, 0
                elif found == "blank":
                    sent += 1
                continue
            word, label, pos, size = found
            for add, value in zip(put, (doc, sent, unit, begin, begin + size, word, label, pos)):
                add(value)
            unit, begin = unit + 1, begin + size + 1
        ends.append(len(out[0]))
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(out, _UNIT)], fields=list(_UNIT))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _content_units(files: DataFrame, doc_break: str, i_word: int, i_label: int, i_pos: int | None,
                   file_col: str, content_col: str, prepartitioned: bool) -> DataFrame:
    """:func:`conll_units` of files given as one row each, in the marker
    layout: each file is read once from its first line to its last, and no line
    is sorted. Rows of one file are one."""
    d = files.where(F.col(file_col).isNotNull()).select(file_col, F.col(content_col).alias("_content"))
    if not prepartitioned:
        d = d.repartition(text_partitions(files.sparkSession, files), file_col)
    per = d.groupBy(file_col).agg(F.collect_list("_content").alias("_contents"))
    at = (doc_break, i_word - 1, i_label - 1, i_pos - 1 if i_pos else None)

    def units(contents: pa.Array) -> pa.Array:
        return _units_of(contents, *at)

    kinds = ",".join(f"{f.name}:{ {pa.int32(): 'int', pa.int64(): 'bigint', pa.string(): 'string'}[f.type]}" for f in _UNIT)
    found = per.select(file_col, F.inline(F.arrow_udf(units, f"array<struct<{kinds}>>")("_contents")))
    return found.select(file_col, "doc_ord", "sent_ord", "tok_idx", "begin", "end", "word", "label", "pos")


def conll_documents(units: DataFrame, file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """Documents (text = words joined by one space) and Sentence spans."""
    # one pass over a document's units: a distinct count would expand and exchange them twice
    docs = units.groupBy(file_col, "doc_ord").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "word"))),
                                 lambda x: x["word"]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_tokens"), F.size(F.collect_set("sent_ord")).cast("long").alias("n_sentences"))
    sents = units.groupBy(file_col, "doc_ord", "sent_ord").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"))
    return docs, sents


def conll_mentions(units: DataFrame, mention_class: str = "EntityMention", compat: bool = False, linked_compat: bool = False,
                   file_col: str = "file") -> DataFrame:
    """The mentions of a column file's units: ``file, doc_ord, begin, end,
    ner_type, first_unit, type``, where ``type`` is the annotation class asked
    for (S7). ``compat``: an open mention is dropped at the end of a document
    and goes on over sentence ends (Q1, Q5). ``linked_compat``: ends as the
    linked reader sets them, at the next word's begin, and at the end of a
    document at the last word's begin (Q2)."""
    from tessera.operators.tags import iob_decode

    key = [file_col, "doc_ord"]
    found = iob_decode(units, key=key, segment=None if compat else "sent_ord", compat=compat)
    if linked_compat:
        w = Window.partitionBy(*key).orderBy("tok_idx")
        ends = units.select(*key, "end", F.coalesce(F.lead("begin").over(w), "begin").alias("_next"))
        found = found.join(ends, [*key, "end"]).withColumn("end", F.col("_next"))
    return found.select(*key, "begin", "end", "ner_type", "first_unit", F.lit(mention_class).alias("type"))


def parse_links(files: DataFrame, file_col: str = "file", content_col: str = "content",
                doc_break: str = DOC_BREAK, lines_given: bool = False, compat: bool = False) -> DataFrame:
    """``.link.tsv`` side file -> ``file, doc_ord, token_idx, yago2_entity,
    wiki_url, wiki_id, freebase_mid``; per token the last row wins; rows
    with fewer than 4 fields (``--NME--``) give nulls (S8, J3). Documents
    are numbered like the column file (split-wise marker counts), so a
    large side file is read in parallel splits too. ``compat``: blocks are
    numbered without the empty ones, so that a document without links takes
    the next block's (Q7)."""
    lines = files if lines_given else content_lines(files, file_col, content_col)
    rows = number_documents(lines, doc_break)
    rows = rows.where(py_strip("line") != "").withColumn("f", py_split("line"))
    full = F.size("f") >= 4
    rows = rows.select(F.col("file").alias(file_col), "doc_ord", "block", "pos",
                       F.element_at("f", 1).try_cast("int").alias("token_idx"),
                       F.when(full, F.element_at("f", 2)).alias("yago2_entity"),
                       F.when(full, F.element_at("f", 3)).alias("wiki_url"),
                       F.when(full, F.element_at("f", 4).try_cast("int")).alias("wiki_id"),
                       F.when(F.size("f") >= 5, F.element_at("f", 5)).alias("freebase_mid"))
    if compat:
        filled = rows.select(file_col, "doc_ord").distinct()
        w = Window.partitionBy(file_col).orderBy("doc_ord")  # one row per document
        filled = filled.withColumn("_nth", F.row_number().over(w))
        rows = rows.join(filled, [file_col, "doc_ord"]).drop("doc_ord").withColumnRenamed("_nth", "doc_ord")
    return (rows.where(F.col("token_idx").isNotNull())
            .groupBy(file_col, "doc_ord", "token_idx")
            .agg(F.max_by(F.struct("yago2_entity", "wiki_url", "wiki_id", "freebase_mid"),
                          F.struct("block", "pos")).alias("l"))
            .select(file_col, "doc_ord", "token_idx", "l.*"))


def attach_links_by_token(mentions: DataFrame, links: DataFrame, file_col: str = "file") -> DataFrame:
    """Mention gets the link row whose token index is its first token."""
    return mentions.join(links.withColumnRenamed("token_idx", "first_unit"),
                         [file_col, "doc_ord", "first_unit"], "left")


def read_conll_linked(spark: SparkSession, path: str, ext: str = ".conll",
                      column_format=("word", None, None, "entity_label"), doc_break: str = DOC_BREAK,
                      suffix: str = LINK_SUFFIX) -> tuple[DataFrame, DataFrame]:
    """Column files with their link side files on disk (S8): ``(units,
    links)``; a side file has the column file's path with its extension
    replaced by ``suffix``, and both results carry the column file's path as
    ``file``. A column file without a side file has no link rows."""
    units = read_conll(spark, path, ext, column_format, doc_break)
    links = parse_links(scan_lines(spark, path, suffix), doc_break=doc_break, lines_given=True)
    dotted = ext if ext.startswith(".") else "." + ext
    return units, links.withColumn("file", F.concat(F.expr(f"substring(file, 1, length(file) - {len(suffix)})"), F.lit(dotted)))


# ----------------------------------------------------- tables / packs

def from_table(df: DataFrame, id_col: str, text_col: str, source: str | None = None) -> DataFrame:
    """Adapt any table with a text column to ``documents`` (S13); the key
    keeps its type."""
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    cols.append(F.lit(source).alias("source") if source else F.lit(None).cast("string").alias("source"))
    return df.select(*cols)


def read_questions(df: DataFrame, id_col: str = "question_id", text_col: str = "text") -> DataFrame:
    """Questions from any DataFrame or stream, one per row."""
    return df.select(F.col(id_col).alias("question_id"), F.col(text_col).alias("text"))


def split_bad_records(lines: DataFrame, rules: dict, file_col: str = "file", record_col: str = "line"):
    """Route malformed lines to quarantine (S9). ``rules`` maps a reason to
    a boolean column that is true for a *bad* line; the first matching
    reason is kept. Returns ``(good, quarantine(file, record, reason))``."""
    reason = F.lit(None).cast("string")
    for r, cond in reversed(list(rules.items())):
        reason = F.when(cond, F.lit(r)).otherwise(reason)
    tagged = lines.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.where(F.col("_reason").isNotNull()).select(
        F.col(file_col).cast("string").alias("file"), F.col(record_col).cast("string").alias("record"),
        F.col("_reason").alias("reason"))
    return good, bad
