"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through pigeonhole blocks.

Defined cases: a null or word-less text has fingerprint zero and links like any other; repeated rows share one class; a null
doc_id keeps its row, and takes part in its class without naming it. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from basinflow.llm.common import materialize, union_components
from basinflow.session import ship

BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints that share a key and are compared pair by pair; larger groups go by one-bit probes, which is as exact.
PAIRWISE = 64
SLICE = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    slices = ([joined[a:b] for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE])] for k in range(0, len(starts), SLICE))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles)) for shingles in slices)


def majority(slices: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, all different) such that components equal those of all pairs that
    differ in at most 2 bits.

    Of 4 blocks of 16 bits, such a pair agrees in 2 at least: six keys a fingerprint. Groups of up to PAIRWISE are joined
    with themselves; in larger ones, fingerprints at distance 2 meet at the value between them, so each is dealt to its
    one-bit neighbours, where at most 65 can meet.
    """
    wanted = list(combinations(range(BLOCKS), 2))
    masks = [sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * i) for i in pair) for pair in wanted]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("way", "key"))
    met = materialize(keys.groupBy("way", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    two = met.where("n = 2").where(close).select("a", "b")
    many = keys.join(met.where("n > 2").select("way", "key", "n"), ["way", "key"])
    many = materialize(many.select("way", "key", "fp", "n"))
    few = many.where(F.col("n") <= PAIRWISE)
    pairs = few.withColumnRenamed("fp", "a").join(few.select("way", "key", F.col("fp").alias("b")), ["way", "key"]).where("a < b").where(close).select("a", "b")
    around = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    crowd = many.where(F.col("n") > PAIRWISE).select("fp").distinct()
    probes = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in around])).alias("probe"))
    meet = probes.groupBy("probe").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").where(close)
    return reduce(DataFrame.union, [two, pairs, star]).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id: classes of texts whose fingerprints link at 2 or fewer differing bits."""
    ship(docs.sparkSession)
    prints = materialize(docs.select("doc_id", _fingerprints(F.col("text")).alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = union_components(near_fingerprints(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(placed.join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir):
    from basinflow.llm.common import table

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
