"""Exact duplicates by a 128-bit content hash, confirmed by comparing bytes.

The 16-byte hashes are counted first, without a text. Of the hashes that occur more than once the leading PREFIX_BITS bits make a set of
at most 2^PREFIX_BITS numbers, which goes to every task; a text whose prefix isn't in it has no copy and stays where it is. The others, which
are the copies and few more (all texts, where the copies outnumber the prefixes by far), are grouped by hash and text. Spark compares such keys byte for byte, so two texts that collide in the hash
fall into different groups. The aggregation combines before the shuffle: a text with a million copies arrives once from each task. So a text is shuffled once at most,
and no text is when documents are matched with the one that stays: that is a join by hash, but for hashes that two texts share.

Defined cases: a null text equals nothing, not even another null; an empty text equals an empty text. Of rows with the same text
the least doc_id stays; null ids come last. Rows that repeat the same doc_id and text are one document: one row stays.
Further columns of any name and type pass through; among rows that tie in text and doc_id the least in the other sortable columns stays. Nothing is trimmed or folded:
texts that differ in one byte differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop_written, fresh, written

#: A multiple of 4; bounds what is sent to every task.
PREFIX_BITS = 20
LOST = (T.MapType, T.VariantType)


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("string")))


def _prefix(h: Column) -> Column:
    """The leading PREFIX_BITS bits as a number."""
    return F.conv(F.substring(F.hex(h), 1, PREFIX_BITS // 4), 16, 10).cast("int")


def _prefixes(hashes: DataFrame, name: str) -> DataFrame:
    """The prefixes (name) of hashes h that occur more than once: 2^PREFIX_BITS rows of 4 bytes at most, whatever the size of the input."""
    return hashes.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select(_prefix(F.col("h")).alias(name)).distinct()


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """(doc_id, kept_doc_id, content_hash): each further document of a group of equal texts, with the one that stays. A document of null id can't be
    named and isn't listed."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).withColumn("h", hash_fn(F.col("_text"))).where("h IS NOT NULL")
    ids = written(slim.select("doc_id", "h"), "hashes")
    prefixes = written(_prefixes(ids, "_p"), "prefixes")
    texts = slim.join(F.broadcast(prefixes), _prefix(F.col("h")) == prefixes["_p"], "left_semi")
    groups = written(texts.groupBy("h", "_text").agg(F.min("doc_id").alias("kept_doc_id"), (F.count("*") > 1).alias("_more")), "groups")
    by_hash = groups.groupBy("h").agg(F.count("*").alias("_texts"), F.min("kept_doc_id").alias("kept_doc_id"), F.max("_more").alias("_more"))
    out = ids.join(by_hash.where("_texts = 1 AND _more").select("h", "kept_doc_id"), "h").select("doc_id", "kept_doc_id", "h")
    shared = by_hash.where("_texts > 1").select("h")
    if shared.isEmpty():
        drop_written(prefixes)
    else:  # two texts of one hash are matched by the text itself
        out = out.unionByName(texts.join(shared, "h", "left_semi").join(groups.where("_more").select("h", "_text", "kept_doc_id"), ["h", "_text"]).select("doc_id", "kept_doc_id", "h"))
    return out.where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id", F.lower(F.hex("h")).alias("content_hash")).distinct()


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """docs with one row of each text."""
    h, p, rank, row = fresh(docs, "_hash", "_prefix", "_rank", "_row")
    some = F.broadcast(written(_prefixes(docs.select(hash_fn(docs[text_col]).alias("h")), p), "prefixes"))
    own = _prefix(hash_fn(docs[text_col]))
    single, same = docs.join(some, own == some[p], "left_anti"), docs.join(some, own == some[p], "left_semi")
    order = [F.col(f.name) for f in docs.schema.fields if f.name not in (id_col, text_col) and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, LOST)]
    rest = [c for c in docs.columns if c != text_col]
    ranked = same.withColumn(h, hash_fn(same[text_col])).withColumn(rank, F.struct(F.col(id_col).isNull(), F.col(id_col), *order)).withColumn(row, F.struct(*rest))
    kept = ranked.groupBy(h, text_col).agg(F.min_by(row, rank).alias(row)).select(text_col, f"{row}.*").select(*docs.columns)
    return single.unionByName(kept)


DUPLICATES_SQL = """
SELECT DISTINCT d.doc_id, k.kept_doc_id, md5(d.text) AS content_hash
FROM documents d JOIN (SELECT text, min(doc_id) AS kept_doc_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) k ON d.text = k.text
WHERE d.doc_id <> k.kept_doc_id
"""
