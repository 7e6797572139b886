"""Sharding by weighted rendezvous hashing of record keys.

A record goes to the shard with the smallest -ln(u) / weight, where u is a hash of (seed, shard, key) in (0, 1). Every
shard draws on its own, so a new shard takes records only into itself, about its share of the weight, and a
shard that goes gives its records to the others. A record's place in its shard follows from counts of (shard, block) and
its rank in one block; blocks are dealt out by row, so that neither a shard nor a hot key is ever ranked in one task.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import stored

BLOCK_ROWS = 4096  # records of a block over all shards, about
DIGITS = 13  # hexadecimal digits of a hash that a double holds exactly


def uniform(seed: int, shard: int, key: Column) -> Column:
    """A number in (0, 1) for each shard and key; the key is its text, and a null one is the empty text."""
    text = F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 29) -> Column:
    """Shard of a key, from 0; ``weights``: one for each shard, in order, 0 for a shard that is to get nothing.

    Equal draws (beyond the hash's 52 bits) go to the first shard.
    """
    if not any(w > 0 for w in weights) or any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("weights must be finite, not negative, and one of them positive")
    draws = [F.struct((-F.log(uniform(seed, s, key)) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, seed: int = 29) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    ``size``: bytes of the text and 1; ``text_crc32``: of its bytes, unsigned; a null text has neither bytes nor a difference from
    an empty one. ``shard``: from the doc_id and ``weights`` alone (law ``key``); ``grown_shard``: with one more shard of weight
    ``added``. ``slot``: place in the shard, gapless from 0, in no order of meaning. Rows of one doc_id share a shard, however many
    they are; rows without a doc_id are one key. Ties of equal rows have slots in any order. An empty table
    gives an empty one; other columns are left out.
    """
    key, text = F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # stored once: row numbers are then the same however often a task runs again
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            rendezvous(key, weights, seed).alias("shard"),
            rendezvous(key, [*weights, added], seed).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    )
    blocks = max(1, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    before = counts.select("shard", "block", (upto - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1)
    placed = ranked.join(before, ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
