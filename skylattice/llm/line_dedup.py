"""Line de-duplication with DataFrame functions only.

Hashes of lines are range-partitioned with document and position behind them in the key, so a line that a third of all
documents hold is spread over many partitions. Within a partition the rows are sorted and the first occurrence in each
document streams out; a hash aggregate that combines before its shuffle then counts documents and finds the largest id.
What comes back is a compressed bitmap for each document: 64-line words, those without a dropped line left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import BLANKS, LOWER, UPPER, checkpoint

#: Names that can't clash with columns of the input, which are carried along as they are.
ID, TEXT, DIGEST, WORDS = "__ld_id", "__ld_text", "__ld_digest", "__ld_words"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each (document, text) that loses lines: id, digest of the text, words (array of (word, bits, n)).

    Bit i of word w is 1 where line 64 * w + i stays; words that are not listed stay whole. A line is dropped if its key
    has at least min_chars code points and is in at least min_docs documents, and the document isn't the one with the
    largest id that holds it. Documents are told apart by id, so repeated rows count once; a null id takes no part.
    Null and empty texts are one empty line. An empty table gives an empty result.
    """
    keyed = checkpoint(  # the texts are split once; sampling for the ranges and both uses below read 40 bytes a line
        spark,
        docs.select(docs[id_col].alias(ID), docs[text_col].alias(TEXT))
        .where(F.col(ID).isNotNull())
        .select(ID, F.xxhash64(TEXT).alias(DIGEST), F.posexplode(lines_of(F.col(TEXT))).alias("pos", "line"))
        .select(ID, DIGEST, "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), ID, DIGEST, "pos"),
    )
    ranged = keyed.repartitionByRange("h1", "h2", ID)
    in_document = Window.partitionBy("h1", "h2", ID).orderBy("pos")
    first = ranged.withColumn("nth", F.row_number().over(in_document)).where("nth = 1")
    # written, so that the join below sees two plain inputs and a hot line's rows can be split over tasks
    common = checkpoint(spark, first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(ID).alias("keeper")).where(F.col("n") >= min_docs).drop("n"))
    lost = keyed.join(common, ["h1", "h2"]).where(F.col(ID) < F.col("keeper"))
    word = F.floor(F.col("pos") / 64).cast("int")
    words = lost.groupBy(ID, DIGEST, word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    return words.groupBy(ID, DIGEST).agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits"), F.bit_count("drop").alias("n")))).alias(WORDS)
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the kept lines joined by \\n in the text column, and __n_lines and __n_dropped beside.

    The bitmaps are the small side of the join: they are hashed, and the texts are dealt out but not sorted. Null and
    empty texts are one empty line and come back as the empty text; rows without an id keep all lines. Columns of the
    input that are named like those that are made here are replaced.
    """
    docs = docs.drop(*{ID, TEXT, DIGEST, WORDS, "__ld_bits", "__n_lines", "__n_dropped"})
    maps = keep_bitmaps(spark, docs, min_chars, min_docs, id_col, text_col)
    left = docs.withColumn(DIGEST, F.xxhash64(docs[text_col]))
    joined = left.join(maps.hint("shuffle_hash"), (left[id_col] == maps[ID]) & (left[DIGEST] == maps[DIGEST]), "left").drop(maps[DIGEST])
    lines, text = lines_of(F.col(f"`{text_col}`")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bits = F.map_from_entries(F.transform(WORDS, lambda w: F.struct(w["word"], w["bits"])))

    kept = F.expr(
        f"array_join(filter(split(coalesce(`{text_col}`, ''), '\\n', -1), (x, i) -> "
        f"coalesce(shiftrightunsigned(try_element_at(__ld_bits, cast(i div 64 as int)), i % 64) & 1L, 1L) = 1L), '\\n')"
    )
    return (
        joined.withColumn("__n_lines", F.size(lines).cast("long"))
        .withColumn("__n_dropped", F.coalesce(F.aggregate(WORDS, F.lit(0), lambda a, w: a + w["n"]), F.lit(0)).cast("long"))
        .withColumn("__ld_bits", bits)
        .withColumn(text_col, F.when(F.col(WORDS).isNull(), text).otherwise(kept))
        .drop(ID, DIGEST, WORDS, "__ld_bits")
    )


def line_dedup(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = drop_repeated_lines(spark, docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < c.keeper, false) AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
