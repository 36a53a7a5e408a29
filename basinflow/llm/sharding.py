"""Extendible hashing: shards by hash prefix, split bit by bit only where a shard is over its byte limit.

The directory is found level by level with counts alone: sizes are summed by prefix at a depth that the total size suggests, a
shard is the shortest prefix that fits, and prefixes that still don't fit are summed again with more bits. Only DataFrame
functions are used.

Defined cases: a null text has 0 bytes; a null doc_id is a key of its own; rows with one doc_id stay together, and where they
alone exceed the limit, or a single text does, their shard is marked oversized at the full depth of 60 bits; an empty table has
no shards. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import materialize

LIMIT_BYTES = 1 << 20
HASH_BITS = 60
#: Bits that one round adds below an oversized prefix.
STEP_BITS = 12


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5, most significant first in the directory's order."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(value: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", value, (F.lit(HASH_BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves (depth, prefix, shard_bytes, shard_docs) for rows (h, n_bytes)."""
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    at, open_rows, leaves = 0, sizes, []
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(1 + total / limit)) + 2))
    while True:
        cells = open_rows.groupBy(prefix(F.col("h"), depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = materialize(cells)
        levels = F.explode(F.sequence(F.lit(at), F.lit(depth)))
        all_levels = cells.select("*", levels.alias("depth"))
        up = F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("depth")).cast("int"))
        nodes = all_levels.groupBy("depth", up.alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS)
        nodes = materialize(nodes)
        fitting = nodes.where(fits)
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("shard_bytes").alias("above"))
        down = F.call_function("shiftright", F.col("prefix"), F.lit(1))
        first = fitting.where(F.col("depth") == at) if at == 0 else fitting.limit(0)
        below = fitting.where(F.col("depth") > at).withColumn("up", down).join(above.where(F.col("above") > limit), ["depth", "up"])
        leaves.append(first.unionByName(below.select(*first.columns)))
        over = nodes.where((F.col("depth") == depth) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("cell"))
        if depth == HASH_BITS or over.isEmpty():
            break
        open_rows = materialize(open_rows.withColumn("cell", prefix(F.col("h"), depth)).join(over, "cell", "left_semi").select("h", "n_bytes"))
        at, depth = depth, min(HASH_BITS, depth + STEP_BITS)
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    return materialize(found)


def shard_documents(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix in bits), shard_bytes, shard_docs, oversized for every row."""
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col("doc_id")).alias("h"))
    sizes = materialize(sizes)
    leaves = directory(sizes, limit)
    # A row lies under one leaf: it is joined at each depth that leaves have, of which there are 61 at most.
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())
    ways = sizes.withColumn("depth", F.explode(F.lit(depths) if depths else F.array().cast("array<int>"))).withColumn("prefix", prefix(F.col("h"), F.col("depth")))
    placed = ways.join(leaves, ["depth", "prefix"])
    bits = F.substring(F.lpad(F.bin("prefix"), HASH_BITS, "0"), F.lit(HASH_BITS + 1) - F.col("depth"), F.col("depth"))
    return placed.select("doc_id", "n_bytes", F.col("depth").cast("long").alias("depth"), bits.alias("shard"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def op4_extendible_hash(spark, sf_dir):
    from basinflow.llm.common import table

    return shard_documents(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
with sizes as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents
), ways as (select s.*, d.depth, h >> (60 - d.depth) as prefix from sizes s, (select unnest(range(0, 61)) as depth) d
), nodes as (select depth, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_docs from ways group by all
), fits as (select * from nodes where shard_bytes <= {LIMIT_BYTES} or depth = 60
), placed as (
  select w.doc_id, w.n_bytes, f.*, row_number() over (partition by w.doc_id order by f.depth) as k
  from ways w join fits f using (depth, prefix)
)
select doc_id, n_bytes, depth, right(prefix::bit::varchar, depth::int) as shard, shard_bytes, shard_docs,
  shard_bytes > {LIMIT_BYTES} as oversized
from placed where k = 1
"""
