"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one maps every text digest to two bits of a blocked filter and keeps the bits that at least two rows hit. Pass two looks each row up in
that filter, which is broadcast: a row with an unset bit has a unique text and passes straight through; only the others shuffle.

Equality: identical after lower-casing A-Z. Null text counts as empty. Of equal texts the largest id stays; a null id is smaller than any
other, and null ids alone keep one. Rows that repeat id and text are one document (counted in ``group_size``). An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import C, ascii_lower, text_or_empty
from barloom.sources.stage import stage

BLOCK_BITS = 32768  # bits of one value of bitmap_construct_agg
BITS_PER_ROW = 16
#: Bound of the broadcast filter: 2^30 bits are 128 MB. Beyond 2^26 rows the filter fills up and passes more rows to the shuffle; results stay whole.
MAX_BITS = 1 << 30


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text)).cast("binary"), 256))


def _slots(digest: Column, blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(digest, F.lit(1))
    return F.pmod(F.xxhash64(digest, F.lit(2)), F.lit(blocks)), F.array_distinct(F.array(h.bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(h, 20).bitwiseAND(BLOCK_BITS - 1)))


def repeated_filter(digests: DataFrame, rows: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """Blocks (block, bits) of the filter whose bits at least two rows of ``digests`` (column ``digest``) hit, and the number of blocks."""
    bits = BLOCK_BITS
    while bits < min(max_bits, rows * BITS_PER_ROW):
        bits *= 2
    blocks = bits // BLOCK_BITS
    block, slots = _slots(C("digest"), blocks)
    hits = digests.select((block * BLOCK_BITS).alias("base"), F.explode(slots).alias("pos")).groupBy((C("base") + C("pos")).alias("slot")).count().filter("count > 1")
    return hits.groupBy(F.expr(f"slot div {BLOCK_BITS}").alias("block")).agg(F.expr(f"bitmap_construct_agg(slot % {BLOCK_BITS})").alias("bits")), blocks


def flag_repeated(rows: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with column ``maybe_repeated``: false only where no other row has the digest in column ``digest``."""
    block, slots = _slots(C("digest"), blocks)
    byte = lambda p: F.conv(F.hex(F.substring(C("_bits"), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.forall("_slots", lambda p: (F.floor(byte(p) / F.pow(F.lit(2), p % 8)) % 2) == 1)
    marked = rows.withColumns({"_block": block, "_slots": slots})
    held = filter_blocks.select(C("block").alias("_of"), C("bits").alias("_bits"))
    return marked.join(F.broadcast(held), C("_block") == C("_of"), "left").withColumn("maybe_repeated", F.coalesce(bit, F.lit(False))).drop("_block", "_slots", "_of", "_bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = stage(docs.select(C(id_col).alias("doc_id"), text_digest(C(text_col)).alias("digest")))
    flagged = flag_repeated(keys, *repeated_filter(keys, keys.count(), max_bits))
    single = flagged.filter("NOT maybe_repeated").select("doc_id", C("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    # copies are counted before they shuffle; the join meets hot digests with the many sides split by adaptive execution
    copies = flagged.filter("maybe_repeated").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = flagged.filter("maybe_repeated").groupBy(C("digest").alias("_of")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    several = copies.join(groups, C("digest") == C("_of")).select("doc_id", "keep_id", "group_size", "digest")
    return single.unionByName(several).select("doc_id", "keep_id", "group_size", C("doc_id").eqNullSafe(C("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows with the same id and text: the one whose other columns hash highest."""
    digest = text_digest(C(text_col))
    keys = stage(docs.select(digest.alias("digest")))
    bloom = repeated_filter(keys, keys.count(), max_bits)
    whole = docs.select(F.struct("*").alias("row"), digest.alias("digest"))
    flagged = flag_repeated(whole, *bloom)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    best = F.max_by("row", F.struct(C("row")[id_col], F.xxhash64(*[C("row")[c] for c in plain])))
    several = flagged.filter("maybe_repeated").groupBy("digest").agg(best.alias("row")).select("row.*")
    return flagged.filter("NOT maybe_repeated").select("row.*").unionByName(several)


SQL = """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT DISTINCT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
