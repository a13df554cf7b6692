"""Exact duplicate groups by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions. Each level aggregates narrow keys (no text is shuffled) and passes on the
keys that more than one row has. What a level passes to the next scan is a bitmap of a fixed number
of bits, so rows whose key is surely alone are neither hashed further nor joined: a prefix is hashed
only where a length repeats, the whole text only where a prefix repeats. A false hit of the bitmap
costs one hash and can't change a group, as groups are those of equal full hashes.

Defined results: null text is empty text; rows with equal text are one group, also if doc_id repeats
or is null (nulls sort below every id); `kept` marks the rows with the group's largest doc_id;
very long texts are hashed whole; extra columns are ignored by `duplicate_groups` and kept by `deduplicate`; empty
input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import shared
from paperloom.llm.columns import free

PREFIX_CHARS = 256
FILTER_BITS = 1 << 22


def _bitmap(keys: DataFrame, hashed: Column, bits: int) -> Column:
    """A scalar subquery: the set of key hashes as an array of bits/64 longs, whatever their number."""
    spark, words = keys.sparkSession, bits // 64
    slot = F.pmod(hashed, F.lit(bits))
    found = (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    )
    whole = spark.range(0, words, 1, 4).join(F.broadcast(found), F.col("id") == F.col("word"), "left")
    return (
        whole.select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("one"))
        .agg(F.array_sort(F.collect_list("one")).alias("all"))
        .select(F.transform("all", lambda x: x["bits"]))
        .scalar()
    )


def _hit(bitmap: Column, hashed: Column, bits: int) -> Column:
    slot = F.pmod(hashed, F.lit(bits))
    word = F.element_at(bitmap, (F.floor(slot / 64) + 1).cast("int"))
    return F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS, digest: bool = False,
) -> DataFrame:
    """Per row of docs: id, keep_id, group_size, kept, full_hash (null where no full hash was needed).

    digest: add the column of that name, the hash of every row's text, for a report that has to
    carry it; the grouping doesn't use it.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    size = F.octet_length("body")
    length_key = F.xxhash64(F.col("size"))
    prefix_key = F.xxhash64("size", "prefix")

    lengths = base.groupBy(size.alias("size")).count().where("count > 1")
    by_length = _bitmap(lengths, length_key, filter_bits)

    sized = base.withColumn("size", size)
    prefix = F.xxhash64(F.substring("body", 1, prefix_chars))
    prefixes = (
        sized.where(_hit(by_length, length_key, filter_bits))
        .groupBy("size", prefix.alias("prefix")).count().where("count > 1")
    )
    by_prefix = _bitmap(prefixes, prefix_key, filter_bits)

    keyed = sized.withColumn("prefix", F.when(_hit(by_length, length_key, filter_bits), prefix))
    again = F.col("prefix").isNotNull() & _hit(by_prefix, prefix_key, filter_bits)
    more = [F.sha2("body", 256).alias("digest")] if digest else []
    narrow = keyed.select("id", F.when(again, F.sha2("body", 256)).alias("full_hash"), *more)
    groups = (
        narrow.where("full_hash is not null").groupBy("full_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where("n > 1")
        .select(F.unhex("full_hash").alias("group_key"), "n", "last")
    )
    # The join is on another form of the key than the aggregation: both sides are then dealt out for
    # the join itself, and adaptive execution may split the partition of a very large group. Rows
    # without a full hash get a key of their own, so that they don't meet in one partition.
    own = F.encode(F.concat(F.lit("id "), F.coalesce(F.col("id").cast("string"), F.lit(""))), "UTF-8")
    joined = narrow.join(groups, F.coalesce(F.unhex("full_hash"), own) == F.col("group_key"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("last"))).alias("kept"),
        "full_hash",
        *(["digest"] if digest else []),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest id, with all its columns.

    Rows that repeat both id and text count as one document: one of them stays. A row whose id is
    null stays only if no row with an id has its text.
    """
    key, full, many = free(docs, "_id", "_hash", "_many")
    found = duplicate_groups(docs, id_col, text_col).where("full_hash is not null")  # the others are alone
    # Rows of a repeated id can differ in text, so the text's hash is part of the key. A key stands for one
    # row that goes, for several equal rows of which one stays, or is not needed.
    rows = found.groupBy(F.col(id_col).alias(key), F.col("full_hash").alias(full)).agg(F.bool_and("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias(many))
    told = shared.written(rows.where(~F.col("kept") | F.col(many)).select(key, full, "kept", many), "exact-groups")
    body = F.coalesce(F.col(text_col), F.lit(""))
    # Only rows whose id is told of are shuffled with their texts.
    bits = 4 * FILTER_BITS
    may = _hit(_bitmap(told, F.xxhash64(key), bits), F.xxhash64(F.col(id_col)), bits)
    alone, some = docs.where(~may), docs.where(may)

    def same(other: DataFrame):
        return some[id_col].eqNullSafe(other[key]) & (F.sha2(body, 256) == other[full])

    lost = told.select(key, full)
    kept = alone.unionByName(some.join(lost, same(lost), "left_anti"))
    again = told.where("kept").select(key, full)
    if again.isEmpty():
        return kept
    return kept.unionByName(some.join(again, same(again), "left_semi").dropDuplicates([id_col, text_col]))
