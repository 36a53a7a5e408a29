"""Near copies for the corpus pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: fingerprints of the five-word shingles that are equal, or that the pigeonhole blocks of simhash.py find within 2
bits, propose pairs. Two bits of 64 mean a similarity of about 0.99, and no block of a fingerprint is left alone at 0.8, where about
10 bits differ. So MinHash signatures cut into BANDS bands of ROWS propose the others: a pair at similarity s shares a band with
probability 1 - (1 - s^ROWS)^BANDS, which is 0.9996 at 0.8. Of a proposed pair the numbers of shingles are compared first, then, of
sets of MANY shingles or more, the fingerprints: over CLOSE_BITS differing bits are five standard deviations above what 0.8 leads to.
Then it is verified on the shingles themselves.

In a band's bucket every text is compared with the smallest; where that leaves several classes, all pairs across classes are, or in
buckets of over PAIRWISE texts, each text with one more of the bucket in each of ROUNDS rounds. Crowded buckets that still hold
several classes then go through a join on rare shingles (crowded_pairs), which misses no pair among their texts and makes none whose
first shared shingle comes too late: texts of one template that are just not alike enough have all that they share behind what tells
them apart.

Defined cases: texts are alike by their lower-case (ASCII) words; a text of fewer than five words is one shingle; null and
word-less texts have none and are copies of each other; equal texts are told by XXH64. Columns other than doc_id and text are only
looked at to choose between rows that repeat both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from basinflow.llm.common import discard, materialize, union_components
from basinflow.llm.simhash import majority, near_fingerprints
from basinflow.session import ship

WIDTH, PERCENT = 5, 80
BANDS, ROWS, PAIRWISE, ROUNDS, CLOSE_BITS, MANY = 20, 5, 64, 2, 24, 64
#: In the join on rare shingles: sizes of sets grow by this factor from class to class, shingles are counted in so many cells, and
#: sets are drawn as so many words of bits.
STEP, CELLS, WORDS = 1.1, 1 << 20, 8
BATCH_ROWS = 1000
SLICE = 512
_factors = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - WIDTH] + 1).tolist()]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends[WIDTH - 1 :].tolist())), np.uint64, len(starts))


def prints(text: str | None) -> tuple[int, int, list[int]]:
    """The SimHash fingerprint of the set of shingles, its size, and the keys of the bands."""
    hashes = np.unique(shingles(text))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[k : k + SLICE, None] * _factors).min(axis=0))
    keys = [xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)]
    fp = np.array([majority(hashes[k : k + (1 << 16)] for k in range(0, len(hashes), 1 << 16))], np.uint64)
    return int(fp.view(np.int64)[0]), len(hashes), np.array(keys, np.uint64).view(np.int64).tolist()


@lru_cache(maxsize=128)
def _set(text: str) -> np.ndarray:
    return np.unique(shingles(text))


def alike(one: str, other: str) -> bool:
    a, b = _set(one), _set(other)
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("size", LongType()), StructField("bands", ArrayType(LongType()))]))
def _prints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([prints(t) for t in texts], columns=["fp", "size", "bands"])


@F.pandas_udf(BooleanType())
def _alike(ones: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([alike(a, b) for a, b in zip(ones, others)], dtype=bool)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are alike; texts are (node, text), one for each."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    held = materialize(texts.join(_ends(pairs), "node", "left_semi"))
    met = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("one")), "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("other")), "a")
    found = materialize(met.where(_alike("other", "one")).select("a", "b"), BATCH_ROWS)
    discard(held, pairs)
    return found


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs of texts with equal fingerprints, each with the smallest, and of the smallest ones of close fingerprints."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = near_fingerprints(first.select("fp")).withColumnRenamed("a", "x").withColumnRenamed("b", "y")
    close = close.join(first.select(F.col("fp").alias("x"), F.col("first").alias("a")), "x").join(first.select(F.col("fp").alias("y"), F.col("first").alias("b")), "y")
    return equal.union(close.select("a", "b")).where("a <> b")


def _close(pairs: DataFrame) -> DataFrame:
    """Pairs of structs (node, fp, size) that can be near copies, as nodes."""
    a, b = (F.col(f"{x}.size") for x in "ab")
    alike_sizes = 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)
    near = (F.least(a, b) < MANY) | (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= CLOSE_BITS)
    return pairs.where(alike_sizes & near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def size_class(size: float) -> int:
    return math.floor(math.log(max(size, 1)) / math.log(STEP))


def rarity(crowd: DataFrame) -> np.ndarray:
    """How many sets of shingles have one in each of CELLS cells: enough to order shingles from rare to common, in a fixed size."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, _cell(np.unique(shingles(text.as_py()))), 1)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["cell", "n"])

    found = crowd.select("text").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % CELLS


def drawn(text: str) -> list[int]:
    """WORDS of 64 bits, each bit set if an odd number of shingles falls on it. Sets that differ in d shingles differ in at most d
    bits."""
    odd = np.bincount((np.unique(shingles(text)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def first_shingles(text: str, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(h, own class, low, high) for the first shingles, in the order of all, by the classes of sizes that a partner may have: as many
    as the least size of a class allows. A shingle that is alone in its cell is in no other set, and left out."""
    hashes = np.unique(shingles(text))
    size, own = len(hashes), size_class(len(hashes))
    found = counts[_cell(hashes)]
    order = np.lexsort((hashes, found))
    ordered, alone = hashes[order].view(np.int64).tolist(), int((found == 1).sum())
    for other in range(size_class(size * PERCENT / 100) - 1, size_class(size * 100 / PERCENT) + 2):
        least = max(STEP ** (other - 1), size * PERCENT / 100)  # of the class, rounding aside
        common = math.ceil(PERCENT / (100 + PERCENT) * (size + least) - 1e-6)
        for h in ordered[alone : max(0, size - common + 1)]:
            yield h, own, min(own, other), max(own, other)


def crowded_pairs(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of structs (a, b) of (b, root) rows that can be alike, all of those that are among them, across classes only.

    The shingles of all sets have one order, from rare to common among these texts. Where two sets of sizes x and y are alike, they
    share o = 80 / 180 (x + y) shingles at least, so the first that they share stands at most at place x - o + 1 of the one and
    y - o + 1 of the other. A set is so dealt out by its first shingles alone. They differ in x + y - 2 o shingles at most, and so
    do the bits that the sets are drawn as.
    """
    crowd = materialize(texts.join(placed.select("b", "root", F.col("b.node").alias("node")), "node").select("b", "root", "text"))
    counts = crowd.sparkSession.sparkContext.broadcast(rarity(crowd))
    key = ["h", "low", "high"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                found = list(zip(*first_shingles(text.as_py(), counts.value)))
                if found:
                    same = batch.slice(k, 1).take(pa.array(np.zeros(len(found[0]), np.int64)))
                    bits = pa.array([drawn(text.as_py())] * len(found[0]), pa.list_(pa.int64()))
                    columns = [same.column("b"), same.column("root"), bits, *(pa.array(c, pa.int64()) for c in found)]
                    yield pa.RecordBatch.from_arrays(columns, ["b", "root", "bits", "h", "own", "low", "high"])

    fields = [StructField("bits", ArrayType(LongType())), *(StructField(c, LongType()) for c in ("h", "own", "low", "high"))]
    schema = StructType([*crowd.select("b", "root").schema.fields, *fields])
    dealt = materialize(crowd.mapInArrow(deal, schema))
    mixed = dealt.groupBy(*key).agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select(*key)
    left = materialize(dealt.join(mixed, key))
    lower, higher = (left.where(F.col("own") == F.col(side)) for side in ("low", "high"))
    pairs = lower.select(*key, F.col("b").alias("a"), F.col("root").alias("x"), F.col("bits").alias("p")).join(higher.select(*key, "b", F.col("root").alias("y"), F.col("bits").alias("q")), key)
    differ = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(1, WORDS)), F.bit_count(F.col("p")[0].bitwiseXOR(F.col("q")[0])))
    few = (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("a.size") + F.col("b.size"))
    found = materialize(pairs.where("x <> y and (low < high or a.node < b.node)").where(few).select("a", "b").distinct())
    discard(crowd, dealt, left)
    return found


def near_edges(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified pairs (a, b) that link the near copies among nodes (node, fp, size, bands), all different."""
    keys = nodes.select(F.struct("node", "fp", "size").alias("b"), F.posexplode("bands").alias("way", "key"))
    met = materialize(keys.groupBy("way", "key").agg(F.count("*").alias("n"), F.min("b").alias("a"), F.max("b").alias("b")).where("n > 1"))
    many = materialize(keys.join(met.where("n > 2").select("way", "key", "n", "a"), ["way", "key"]))
    two = met.where("n = 2").select("a", "b")
    equal = materialize(_by_fingerprint(nodes))
    # Texts are dealt out once: those of all that meet anywhere.
    wanted = _ends(equal.union(_close(two))).union(many.select("b.node")).union(met.where("n > 2").select("a.node")).distinct()
    texts = materialize(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))
    edges = _verified(equal.union(_close(two.union(many.select("a", "b")).distinct())), texts)
    left = many.where("a <> b").select("way", "key", "n", "b").union(met.where("n > 2").select("way", "key", "n", F.col("a").alias("b")))
    for turn in range(ROUNDS):
        roots = union_components(edges).withColumnRenamed("node", "x")
        placed = materialize(left.join(roots, F.col("b.node") == F.col("x"), "left").select("way", "key", "n", "b", F.coalesce("root", "b.node").alias("root")))
        # The same lead in all buckets that share it: a pair is proposed once.
        lead = F.min_by(F.struct("b", "root"), F.xxhash64(F.lit(turn), "b.node")).alias("lead")
        mixed = placed.groupBy("way", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead).where("low <> high")
        still = materialize(placed.join(mixed.select("way", "key", "lead"), ["way", "key"]))
        proposed = still.where((F.col("n") > PAIRWISE) & (F.col("root") != F.col("lead.root"))).select(F.col("lead.b").alias("a"), "b").distinct()
        if not turn:
            few = still.where(F.col("n") <= PAIRWISE)
            across = few.select("way", "key", F.col("b").alias("a"), F.col("root").alias("x")).join(few.select("way", "key", "b", F.col("root").alias("y")), ["way", "key"])
            proposed = proposed.union(across.where("a < b and x <> y").select("a", "b"))
        edges = edges.union(_verified(_close(proposed), texts))
        left = still.where(F.col("n") > PAIRWISE).select("way", "key", "n", "b")
        if left.isEmpty():
            break
    else:
        roots = union_components(edges).withColumnRenamed("node", "x")
        placed = left.join(roots, F.col("b.node") == F.col("x"), "left").select("way", "key", "b", F.coalesce("root", "b.node").alias("root"))
        mixed = placed.groupBy("way", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        crowd = materialize(placed.join(mixed, ["way", "key"], "left_semi").select("b", "root").distinct())
        edges = edges.union(_verified(_close(crowded_pairs(crowd, texts)), texts))
    discard(met, many, equal, texts)
    return edges


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each class of near copies: that of the smallest doc_id, null last, then of the smallest text hash, then
    of the smallest columns. All columns stay."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    node = F.xxhash64(text)
    texts = docs.select(node.alias("node"), text.alias("text"))
    made = materialize(docs.select("doc_id", node.alias("node"), _prints(F.col("text")).alias("p")).select("doc_id", "node", "p.fp", "p.size", "p.bands"), BATCH_ROWS)
    nodes = materialize(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands")))
    roots = union_components(near_edges(nodes, texts))
    copies = made.groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")
    first = copies.groupBy("node").agg(F.min(order).alias("first"))
    first = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("f"))
    kept = materialize(first.select(F.col("f.node").alias("kept"), F.col("f.doc_id").alias("id"), F.col("f.n").alias("n")))
    discard(made, nodes)
    marked = docs.select(F.struct(*docs.columns).alias("row"), node.alias("node"))
    same = (F.col("node") == F.col("kept")) & F.col("row.doc_id").eqNullSafe(F.col("id"))
    once = marked.join(kept.where("n = 1"), same, "left_semi").select("row")
    more = marked.join(kept.where("n > 1"), same, "left_semi").groupBy("node").agg(F.min("row").alias("row")).select("row")
    return once.union(more).select("row.*")
