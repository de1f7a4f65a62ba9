"""A Merkle manifest of a table: built bottom-up, with proofs pushed top-down.

Levels are persisted in strips of HEIGHT levels: a row of a strip is a page, 2^HEIGHT neighbours of its lowest level with
the HEIGHT levels over them. Going up, the tops of a strip's pages are the lowest level of the next strip. Going down,
the pages of a strip join what their parents in the strip above inherited; each child prepends its siblings to that
proof suffix. So a tree over n leaves takes log2(n) / HEIGHT rounds each way, each round touches 2^HEIGHT times fewer
rows than the one before, and only leaves and their numbers are shuffled. A group that holds most of the rows is cut into
ranges and pages like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, doc_crc

#: Levels in a strip.
HEIGHT = 6
#: Rows (one for each range and group) up to which the numbers of first leaves are broadcast.
BROADCAST_ROWS = 100_000


def field(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value; integers in decimal."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def group_key(column: Column) -> Column:
    """Text that sorts as the column does by its bytes, null first, and tells null from the empty text."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def numbered(spark: SparkSession, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """nodes with `at`, the place in their key from 0 in the order of the columns `by`, and `n`, how many the key has.

    Rows are sorted into ranges over all keys and written; a range's first number and the rows of the key in the ranges
    before it make the place, so no task orders a whole key.
    """
    dealt = nodes.repartitionByRange("key", *by).sortWithinPartitions("key", *by).withColumn("__at", F.monotonically_increasing_id())
    dealt = checkpoint(spark, dealt).withColumn("__part", F.shiftright("__at", 33))
    pieces = dealt.groupBy("key", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__c"))
    key = Window.partitionBy("key")
    before = F.coalesce(F.sum("__c").over(key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = checkpoint(spark, pieces.select("key", "__part", (before - F.col("__first")).alias("__before"), F.sum("__c").over(key).alias("n")))
    if pieces.count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    return dealt.join(pieces, ["key", "__part"]).withColumn("at", F.col("__at") + F.col("__before")).drop("__at", "__part", "__before")


def strip(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """One page for each 2^HEIGHT neighbours of nodes (key, n, at, digest, and columns that are carried): key, n, page,
    rows (of the lowest level), levels (null above a key's only node) and top."""
    carried = [c for c in nodes.columns if c not in ("key", "n")]
    rows = F.sort_array(F.collect_list(F.struct("at", *[c for c in carried if c != "at"])))
    pages = nodes.groupBy("key", F.shiftright("at", HEIGHT).alias("page")).agg(F.max("n").alias("n"), rows.alias("rows"))
    pages = pages.withColumn("l0", F.transform("rows", lambda r: r["digest"]))
    for k in range(HEIGHT):  # two neighbours become their hash, and so does a last one that is alone
        pairs = f"transform(sequence(0, (size(l{k}) - 1) div 2), i -> sha2(concat(l{k}[2 * i], coalesce(get(l{k}, 2 * i + 1), '')), 256))"
        pages = pages.withColumn(f"l{k + 1}", F.expr(f"if(n > {1 << k}, {pairs}, l{k})"))
    levels = F.array(*[F.when(F.col("n") > (1 << k), F.col(f"l{k}")) for k in range(HEIGHT)])
    return checkpoint(spark, pages.select("key", "n", "page", "rows", levels.alias("levels"), F.expr(f"l{HEIGHT}[0]").alias("top")))


def build(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """The strips of all keys' trees, the lowest first."""
    found = [strip(spark, nodes)]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1 << HEIGHT:
        tops = found[-1].where(F.col("n") > 1 << HEIGHT)
        found.append(strip(spark, tops.select("key", F.ceil(F.col("n") / (1 << HEIGHT)).alias("n"), F.col("page").alias("at"), F.col("top").alias("digest"))))
    return found


def roots(strips: Sequence[DataFrame]) -> DataFrame:
    """key and digest of the node that remains of each key."""
    tops = [s.where(F.col("n") <= 1 << HEIGHT).select("key", F.col("top").alias("digest")) for s in strips]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def push(strips: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest strip with their proofs and what `above` (key, proof, more columns) says of their key.

    proof: for each level one text, `L` or `R` and the sibling on that side, or empty for a node that is alone.
    """
    more = [c for c in above.columns if c not in ("key", "proof")]
    siblings = ", ".join(
        f"if(levels[{k}] is null, null, coalesce(concat(if(shiftright(i, {k}) & 1 = 1, 'L', 'R'), get(levels[{k}], shiftright(i, {k}) ^ 1)), ''))" for k in range(HEIGHT)
    )
    children = None
    for pages in reversed(strips):
        inherited = pages.where(F.col("n") <= 1 << HEIGHT).join(above, "key")
        if children is not None:
            below = children.select("key", F.col("row.at").alias("page"), "proof", *more)
            inherited = inherited.unionByName(pages.where(F.col("n") > 1 << HEIGHT).join(below, ["key", "page"]).select(*inherited.columns))
        each = F.expr(f"inline(transform(rows, (row, i) -> struct(row, concat(filter(array({siblings}), x -> x is not null), proof) as proof)))")
        children = inherited.select("key", each, *more)
    return children.select("key", "row.*", "proof", *more)


def manifest(spark: SparkSession, leaves: DataFrame) -> DataFrame:
    """leaves: key, digest, the columns that order a key's leaves (`by`, a struct), and columns that are carried. Returns them with
    proof (see push), subroot (of the key) and root (over the subroots in the order of keys)."""
    trees = build(spark, numbered(spark, checkpoint(spark, leaves), ["by"]))
    subroots = roots(trees).select(F.lit("").alias("key"), F.col("key").alias("by"), "digest")
    top = build(spark, numbered(spark, checkpoint(spark, subroots), ["by"]))
    root = roots(top).select("key", F.expr("array()").cast("array<string>").alias("proof"), F.col("digest").alias("root"))
    above = checkpoint(spark, push(top, root).select(F.col("by").alias("key"), "proof", F.col("digest").alias("subroot"), "root"))
    return push(trees, above)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, x: F.sha2(F.when(x.startswith("L"), F.concat(x.substr(2, 64), acc)).otherwise(F.concat(acc, x.substr(2, 64))), 256))


def dataset_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, changed (the leaf after tampering, null where nothing was) of every row.

    Null fields are `-`. A null lang is a group of its own, before all others; the empty lang is another one. Leaves of a
    lang ascend by doc_id, null ids first; rows of one id are ordered by their leaf, so repeated rows each have a leaf and
    it doesn't matter which is which. Long texts are hashed whole. Other columns are left alone, whatever their names. An
    empty table gives an empty result.
    """
    columns = [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], docs["text"]]
    tampered = (doc_crc(docs["doc_id"]) % 7 == 0) & docs["n_chars"].isNotNull() & docs["doc_id"].isNotNull()
    changed = F.when(tampered, leaf(*columns[:3], (docs["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)"), columns[4]))
    rows = docs.select(group_key(docs["lang"]).alias("key"), docs["doc_id"].alias("doc_id"), leaf(*columns).alias("digest"), changed.alias("changed"))
    out = manifest(spark, rows.withColumn("by", F.struct("doc_id", "digest")).drop("doc_id"))
    return out.select(F.col("by.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof", "changed")


def verified_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest with a digest of each proof, the root that it leads to after tampering, and whether that is the root.
    A null id is never tampered with. See dataset_manifest for odd rows."""
    out = dataset_manifest(spark, docs)
    proof = F.sha2(F.array_join(F.transform("proof", lambda x: x.substr(2, 64)), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text"]


def _leaf_sql(fields: Sequence[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


#: crc32 of a text of digits, bit by bit: its bytes, each followed by seven zero bits' worth of steps.
_CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
)

SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, {_leaf_sql(_FIELDS)} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {_CRC_SQL} % 7 = 0
              THEN {_leaf_sql([*_FIELDS[:3], "(n_chars + 1)::VARCHAR", "text"])} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r
  FROM rows_),
tree(lang, lvl, place, digest, n) AS (
  SELECT lang, 0, place, leaf, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), max((n + 1) // 2)
  FROM tree WHERE n > 1 GROUP BY lang, lvl, place // 2),
subs AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, place, digest, n) AS (
  SELECT 0, place, digest, n FROM subs
  UNION ALL
  SELECT lvl + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), max((n + 1) // 2)
  FROM top WHERE n > 1 GROUP BY lvl, place // 2),
walk(r, lang, lvl, place, n, proof, acc) AS (
  SELECT r, lang, 0, place, n, '', coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT w.r, w.lang, w.lvl + 1, w.place // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || w.acc ELSE w.acc || coalesce(s.digest, '') END)
  FROM walk w LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.place = xor(w.place, 1)
  WHERE w.n > 1),
rise(r, lang, lvl, place, n, proof, acc) AS (
  SELECT w.r, w.lang, 0, s.place, s.n, w.proof, w.acc FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.r, w.lang, w.lvl + 1, w.place // 2, (w.n + 1) // 2, w.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || w.acc ELSE w.acc || coalesce(s.digest, '') END)
  FROM rise w LEFT JOIN top s ON s.lvl = w.lvl AND s.place = xor(w.place, 1)
  WHERE w.n > 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256,
       f.acc AS folded_root, f.acc = t.digest AS verified
FROM leaves l JOIN rise f ON f.r = l.r AND f.n = 1 JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN top t ON t.n = 1
"""
