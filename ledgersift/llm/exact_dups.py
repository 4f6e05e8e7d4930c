"""Exact copies by two passes of Bloom filtering; only what may repeat is shuffled.

First pass: every row sets the bits of its text's digest. Bits are exchanged as plain positions, combined on the map
side, and a position that more than one row has set goes into the filter of repeated bits. Second pass: each row tests its
own bits in that filter. A row with a bit that nobody else has set is the only one of its kind and passes straight
through; the others, all real copies and the few that share their bits by chance, are shuffled by digest and settled
exactly.

A filter is broadcast and never larger than ``filter_bits``. Beyond ``filter_bits / BITS_PER_ROW`` rows the digests
fall into so many slices, by one formula at every size, and each slice has a filter of its own; slices are dealt with
one after the other, so that one filter at a time is held.

Everything is made of Spark's own expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import new_folder, only, stored

#: Bits of filter for each row, and bits that a row sets: a single row is taken for a copy with probability 0.014.
BITS_PER_ROW = 16
BITS_SET = 2
#: Bits of the largest filter that is broadcast: 32 MB.
FILTER_BITS = 1 << 28
#: Rows of one digest that one task should settle; larger groups are split over so many more tasks.
ROWS_PER_TASK = 1 << 17
#: Parts that any digest's rows are split into at least.
LEAST_PARTS = 256


def digest_of(text: str) -> Column:
    """SHA-256 of a text's UTF-8 bytes as binary; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _bits(size: int) -> list[Column]:
    """The positions, from 1, of a digest's bits in a filter of ``size`` bits."""
    return [F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(size)) + 1 for seed in range(BITS_SET)]


def _slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit("slice")), F.lit(slices))


def repeated_bits(digests: DataFrame, size: int) -> DataFrame:
    """(bucket, bits): the filter of positions set by more than one row, as bitmaps of 32,768 bits.

    Both bits of a row count on their own, so a row whose bits coincide is taken for a copy; no copy is missed.
    """
    hit = (digests.select(F.explode(F.array(*_bits(size))).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("rows"))
           .where("rows > 1"))
    return (hit.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")))


def with_maybe(rows: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """The rows plus ``maybe``: whether all bits of their ``digest`` are in the filter of repeated bits."""
    tested, found = rows, []
    for k, at in enumerate(_bits(size)):
        filter_ = F.broadcast(repeated.select(F.col("bucket").alias(f"__bucket{k}"), F.col("bits").alias(f"__bits{k}")))
        tested = (tested.withColumn(f"__at{k}", at)
                  .join(filter_, F.expr(f"bitmap_bucket_number(__at{k}) = __bucket{k}"), "left"))
        byte = f"conv(hex(substring(__bits{k}, CAST(bitmap_bit_position(__at{k}) DIV 8 + 1 AS INT), 1)), 16, 10)"
        bit = F.expr(f"getbit(CAST({byte} AS INT), CAST(bitmap_bit_position(__at{k}) % 8 AS INT)) = 1")
        found.append(F.coalesce(bit, F.lit(False)))
    return tested.select(*rows.columns, reduce(lambda a, b: a & b, found).alias("maybe"))


def _single(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                       F.lit(True).alias("kept"), "digest")


def _settled(maybe: DataFrame, parts: int) -> DataFrame:
    """The exact groups of rows (at, doc_id, digest).

    A digest's rows are split into parts by their own number, summed up by part and then by digest; what the digest
    keeps goes back to its parts and from there to the rows, so no task meets all rows of a digest.
    """
    rows = maybe.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)))
    by_part = rows.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("n"),
                                                 F.max(F.struct("doc_id", "at")).alias("last"))
    total = by_part.groupBy(F.col("digest").alias("__digest")).agg(F.sum("n").alias("group_size"),
                                                                   F.max("last").alias("keep"))
    known = (by_part.join(total, F.col("digest") == F.col("__digest"))
             .select("__digest", F.col("part").alias("__part"), "group_size", "keep"))
    return (rows.join(known, (F.col("digest") == F.col("__digest")) & (F.col("part") == F.col("__part")))
            .select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    (F.col("at") == F.col("keep.at")).alias("kept"), "digest"))


def _slices(n: int, filter_bits: int) -> tuple[int, int]:
    """Number of slices, and bits of the filter of one."""
    slices = max(1, math.ceil(n * BITS_PER_ROW / filter_bits))
    return slices, max(1 << 15, math.ceil(n / slices) * BITS_PER_ROW)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and ``digest`` (SHA-256 of the text, binary).

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest id
    stays, a null id coming before all others; of rows with equal text and equal id, one stays. In a group without any id
    keep_id is null. Other columns are not read. Texts are read once: digests are written to the shared folder
    and all passes work on them. An empty table gives no rows.
    """
    digests = stored(only(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("at"), "doc_id", digest_of("text").alias("digest")), "digests")
    spark, n = docs.sparkSession, digests.count()
    slices, size = _slices(n, filter_bits)
    parts = max(LEAST_PARTS, math.ceil(n / ROWS_PER_TASK))
    folder = new_folder(spark, "exact")
    for k in range(slices):
        own = digests.where(_slice_of(slices) == k)
        repeated = stored(repeated_bits(own, size), "bits")
        tested = with_maybe(own, repeated, size)
        stored_rows = _single(tested.where(~F.col("maybe"))).unionByName(
            _settled(tested.where("maybe").select("at", "doc_id", "digest"), parts))
        stored_rows.write.parquet(f"{folder}/slice={k}")
    kind = dict(digests.dtypes)["doc_id"]
    schema = f"doc_id {kind}, keep_id {kind}, group_size long, kept boolean, digest binary, slice int"
    return spark.read.schema(schema).parquet(folder).drop("slice")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   filter_bits: int = FILTER_BITS) -> DataFrame:
    """The whole rows that stay, one of each text: those with the largest id, as ``exact_groups`` tells.

    Rows whose text cannot repeat stay where they are, with their texts; only the others are shuffled, combined to
    one row a text before that. All columns come back as they were; of rows that tie in id and text, one stays.
    """
    digests = stored(only(docs, text=text_col).select(digest_of("text").alias("digest")), "digests")
    slices, size = _slices(digests.count(), filter_bits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       digest_of(f"`{text_col}`").alias("digest"))
    done = []
    for k in range(slices):
        repeated = stored(repeated_bits(digests.where(_slice_of(slices) == k), size), "bits")
        tested = with_maybe(rows.where(_slice_of(slices) == k), repeated, size)
        last = (tested.where("maybe").groupBy("digest")
                .agg(F.max_by("row", F.struct(F.col(f"row.`{id_col}`"))).alias("row")))
        done.append(tested.where(~F.col("maybe")).select("row").unionByName(last.select("row")))
    return reduce(DataFrame.unionByName, done).select("row.*")
