"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Rows fall into memtables of about MEMTABLE rows by where they lie in the input, so there are as many as the input asks
for. Each memtable is flushed as a run of level 0: one row for each digest with the smallest and the largest (id, row)
and the number of rows, sorted by digest. Compaction merges FANIN runs of a level to one of the next, until one run is
left: runs have bitmap filters, a digest in no other run's filter passes by, and the others are merged by digest,
keeping the smallest and largest ids. Digests with more than one row are hits: the texts behind them are compared byte
by byte, and equal digests over different texts are taken apart by their texts.

Only digests travel for all rows. Texts travel for probable hits alone, one for each task and digest, as partial minima
and maxima are taken first. Probable hits are picked by a bitmap that has HIT_BITS for each hit up to MOST_HIT_BITS;
beyond that it lets other texts pass too, at worst all, which costs a shuffle and no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, free_name, id_text, join_by_key

#: Rows of a memtable, about; runs that are merged to one of the next level. The smallest inputs have FANIN memtables.
MEMTABLE, FANIN = 4_000_000, 4
#: Bits of a run's filter for each of its digests, before rounding up to a power of two.
FILTER_BITS = 16
#: Bits for each hit of the filter by which the text scan picks probable hits, and the most: 32 MB, so it is broadcast.
HIT_BITS, MOST_HIT_BITS = 16, 1 << 28
#: Bits in one row of a filter: what bitmap_construct_agg makes.
ROW_BITS = 32768


def _position(digest: Column, bits: int) -> Column:
    """A digest's bit, from 0 to bits - 1 (a power of two)."""
    return F.xxhash64(digest).bitwiseAND(F.lit(bits - 1))


def bitmaps(rows: DataFrame, bits: int, *by: str) -> DataFrame:
    """by, bucket, filter: which positions the digests of rows take, ROW_BITS to a row."""
    at = _position(F.col("digest"), bits)
    return (
        rows.select(*by, F.floor(at / ROW_BITS).cast("long").alias("bucket"), (at % ROW_BITS).alias("place"))
        .groupBy(*by, "bucket")
        .agg(F.bitmap_construct_agg("place").alias("filter"))
    )


def _set(bitmap: Column, place: Column) -> Column:
    """Whether a bit is set in a row of a filter."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0, F.lit(False))


def _power(n: int, least: int) -> int:
    return max(least, 1 << max(0, n - 1).bit_length())


def compact(level: DataFrame, rows: int, runs: int, fanin: int = FANIN) -> DataFrame:
    """run, digest, least, greatest, n: each `fanin` runs of a level merged to one."""
    level = level.withColumns({"slot": F.col("run") % fanin, "run": F.floor(F.col("run") / fanin).cast("int")})
    bits = _power(rows * FILTER_BITS * min(fanin, runs) // runs, ROW_BITS)
    filters = bitmaps(level, bits, "run", "slot").groupBy("run", "bucket").agg(*[F.max(F.when(F.col("slot") == i, F.col("filter"))).alias(f"f{i}") for i in range(fanin)])
    at = _position(F.col("digest"), bits)
    probed = level.withColumns({"bucket": F.floor(at / ROW_BITS).cast("long"), "place": at % ROW_BITS}).join(filters, ["run", "bucket"])
    elsewhere = reduce(lambda a, b: a | b, [(F.col("slot") != i) & _set(F.col(f"f{i}"), F.col("place")) for i in range(fanin)])
    probed = probed.select("run", "digest", "least", "greatest", "n", elsewhere.alias("elsewhere"))
    alone = probed.where(~F.col("elsewhere")).drop("elsewhere")
    merged = probed.where("elsewhere").groupBy("run", "digest").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n"))
    return alone.unionByName(merged)


def sieved(rows: DataFrame, hits: DataFrame, many: int, name: str, digest: str = "digest") -> DataFrame:
    """rows (with digest) and whether the hits' filter (of `many` digests, repeats included) doesn't rule them out."""
    bits = min(MOST_HIT_BITS, _power(many * HIT_BITS, ROW_BITS))
    at = _position(F.col(digest), bits)
    bucket, place, sieve = (free_name(rows, x) for x in ("bucket", "place", "sieve"))
    sized = F.broadcast(bitmaps(hits, bits).select(F.col("bucket").alias(bucket), F.col("filter").alias(sieve)))  # MOST_HIT_BITS / 8 bytes at most
    rows = rows.withColumns({bucket: F.floor(at / ROW_BITS).cast("long"), place: at % ROW_BITS}).join(sized, bucket, "left")
    return rows.withColumn(name, F.col(sieve).isNotNull() & _set(F.col(sieve), F.col(place))).drop(bucket, place, sieve)


def keep_rows(docs: DataFrame, contested: DataFrame, text_key: Column, *, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that `contested` (doc_id, text_key, kept) gives up; of equal ids with equal keys one stays.

    Rows that aren't contested stay where they lie, and only texts of those that may be are shuffled: the filter of
    `sieved` tells them apart, and what it lets pass by mistake finds no partner and stays.
    """
    for_digest = lambda i, key: F.sha2(F.concat_ws("\t", F.coalesce(i.cast("string"), F.lit("none")), key.cast("string")), 256)
    own, known, maybe, kept = (free_name(docs, x) for x in ("digest", "known", "maybe", "kept"))
    space = Workspace(docs.sparkSession, "contested")
    decided = contested.groupBy(F.unhex(for_digest(F.col("doc_id"), F.col("text_key"))).alias("digest")).agg(F.max("kept").alias("kept"))
    decided = space.save(decided, "decided")
    rows = docs.withColumn(own, F.unhex(for_digest(F.col(id_col), text_key)))
    rows = sieved(rows, decided, decided.count(), maybe, own)
    some = rows.where(maybe).dropDuplicates([own]).join(decided.select(F.col("digest").alias(known), F.col("kept").alias(kept)), F.col(own) == F.col(known), "left")
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(some.where(F.coalesce(F.col(kept), F.lit(True))).select(*docs.columns))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", memtable: int = MEMTABLE, fanin: int = FANIN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, least_id: one row for each row of docs.

    Texts are equal if their bytes are; a null text counts as empty. Of equal texts the row with the largest id stays
    (a null id is smaller than any; of rows that repeat an id with its text, one stays). keep_id is that row's id and
    least_id the smallest in the group. An empty table gives none. Only the two named columns are read.
    """
    space = Workspace(docs.sparkSession, "exact")
    base = id_text(docs, id_col, text_col)
    own = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("row"))
    keyed = space.save(base.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("text", 256)).alias("digest")), "memtables")
    rows = keyed.count()
    runs = max(fanin, -(-rows // memtable))
    run = F.pmod(F.shiftright("row", 33), F.lit(runs)).cast("int").alias("run")  # by the input's partition
    flushed = keyed.groupBy(run, "digest").agg(F.min(own).alias("least"), F.max(own).alias("greatest"), F.count(F.lit(1)).alias("n"))
    level, height = space.save(flushed.sortWithinPartitions("run", "digest"), "level0"), 0
    while runs > 1:
        merged = compact(level, level.count(), runs, fanin)
        level, height, runs = space.save(merged.sortWithinPartitions("run", "digest"), f"level{height + 1}"), height + 1, -(-runs // fanin)
        space.drop(f"level{height - 1}")
    hits = space.save(level.where("n > 1").drop("run"), "hits")
    texts = sieved(base.select("text", F.unhex(F.sha2("text", 256)).alias("digest")), hits, hits.count(), "hit").where("hit")
    seen = texts.groupBy("digest").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    apart = space.save(seen.where("first <> last").select("digest"), "collisions")
    return _result(keyed, hits, apart, base, space, own, rows)


def _result(keyed: DataFrame, hits: DataFrame, apart: DataFrame, base: DataFrame, space: Workspace, own: Column, total: int) -> DataFrame:
    sha = F.lower(F.hex("digest"))
    if not apart.isEmpty():
        # Equal digests over different texts: such rows are grouped by their texts. No such texts are known for SHA-256.
        hits = hits.join(apart, "digest", "left_anti")
        rows = base.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.unhex(F.sha2("text", 256)).alias("digest")).join(apart, "digest", "left_semi")
        of = rows.groupBy("text").agg(F.min(own).alias("least"), F.max(own).alias("greatest"), F.count(F.lit(1)).alias("n"))
        odd = space.save(rows.join(of, "text").select("doc_id", "row", "digest", "least", "greatest", "n"), "apart")
        keyed = keyed.join(apart, "digest", "left_anti")
    found = join_by_key(keyed, hits.withColumn("size", F.col("n")), "digest", total, "left").select("doc_id", "row", "digest", "least", "greatest", F.col("size").alias("n"))
    if not apart.isEmpty():
        found = found.unionByName(odd)
    mine = F.col("n").isNull() | (F.col("greatest.row") == F.col("row"))
    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return found.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(real("greatest.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        mine.alias("kept"),
        sha.alias("text_sha256"),
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(real("least.id")).alias("least_id"),
    )
