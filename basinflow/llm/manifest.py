"""Merkle manifest of a dataset: three-way hash trees, one for each source and one over the sources, climbed by a recursive query.

H is the lower-case hex SHA-256 of its inputs, one after another, digests as hex text. Leaves are numbered by source and doc_id: rows
are range-partitioned and counted by partition, so that no task sorts a source. Levels are built bottom-up from runs of three and
stored as node rows that link to their parent and hold their siblings. A recursive query then takes each leaf up: every step joins
the node that a leaf has reached, folds the (tampered) hash with the siblings and yields a row with the siblings it passed; these
are appended in order afterwards, since rows that carried them along would move each of them again at every later level.

Nodes near the root are met by all leaves below them. So the climb has two parts: levels with many nodes, joined by key, then the
levels that have at most UPPER_NODES nodes together, which Spark can broadcast by its own statistics of the stored table. Digests are
stored as 32 bytes and are only made hex where they are hashed.

Defined cases: a null field is written `-`; a null source comes first, and so does a null doc_id in its source; rows that repeat a
doc_id are ordered by their leaf, and equal rows are counted before they are numbered; a null doc_id is never tampered with; a single
leaf is its subroot, a single subroot the root, and the proof of a leaf without siblings is the hash of nothing; an empty table gives
no rows. Columns other than the five of the leaf are not looked at.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinflow.llm.common import discard, discarding, materialize, table
from basinflow.session import scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels of the tree over the sources are numbered from here; a source's own tree never has so many.
ROOT = 64
#: Nodes of 130 bytes at most in the part of the climb that may be broadcast.
UPPER_NODES = 50_000
#: Equal rows that one task numbers.
CHUNK = 100_000
LIMITS = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "256"}


@dataclass
class Manifest:
    """leaves: (at, start, doc_id, source, leaf, changed); sources: (source, number, start, n, subroot); nodes: (level, at,
    parent_level, parent_at, before, after) for all nodes but the root, which has its digest and level here, None and 0 if the table
    is empty. All tables are stored."""

    leaves: DataFrame
    sources: DataFrame
    nodes: DataFrame
    root: bytes | None
    root_level: int


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf(text: Column | str = "text") -> Column:
    return digest(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(F.col(text) if isinstance(text, str) else text)))


def tampered_leaf() -> Column:
    """The leaf after newlines are deleted from the text of every second document, by the checksum of doc_id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, leaf(F.translate("text", "\n", ""))).otherwise(leaf())


def numbered(rows: DataFrame, order: list[str], copies: str) -> DataFrame:
    """The rows with `at`, their place from 0 in that order; each stands for so many copies, which follow one another."""
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = ranged.groupBy("part").agg(F.sum(copies).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum(copies).over(inside), F.lit(0))).join(parts, "part")
    return placed.select(*rows.columns, (F.col("offset") + F.col("inner")).cast("long").alias("at"))


def each_copy(rows: DataFrame, copies: str) -> DataFrame:
    """One row for each copy, `at` counted on. Groups over CHUNK are dealt out in parts."""
    plain = [c for c in rows.columns if c not in (copies, "at")]

    def spread(some: DataFrame, size: Column) -> DataFrame:
        return some.select(*plain, F.explode(F.sequence(F.col("at"), F.col("at") + size - 1)).alias("at"))

    few = spread(rows.where(F.col(copies) <= CHUNK), F.col(copies))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(CHUNK).cast("long"))).alias("from")
    parts = rows.where(F.col(copies) > CHUNK).select("*", starts)
    dealt = parts.select(*plain, (F.col("at") + F.col("from")).alias("at"), F.least(F.lit(CHUNK), F.col(copies) - F.col("from")).alias("size")).repartition("at")
    return few.union(spread(dealt, F.col("size")))


def height(n: Column) -> Column:
    """Levels above the leaves: the least h with FAN ** h >= n."""
    return F.size(F.filter(F.lit([FAN**h for h in range(40)]), lambda p: p < n))


def grow(rows: DataFrame, base: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows by level, and the tops (start, at, level, hash) of all trees. rows: (level, at, pos, start, height, hash), one for
    each node at the foot of a tree; pos is its place there. A parent's key is (base + its height, the first place below it)."""
    nodes, k, key = [], 0, ["level", "at", "start", "hash"]
    most = rows.agg(F.max("height")).first()[0] or 0
    tops = [rows.where("height = 0").select(*key)]
    while k < most:
        rows = rows.where(F.col("height") > k)
        k += 1
        up = F.expr(f"pos div {FAN}")
        kids = F.sort_array(F.collect_list(F.struct("pos", "level", "at", "hash"))).alias("kids")
        runs = rows.groupBy("start", "height", up.alias("up")).agg(kids)
        runs = runs.withColumn("hash", digest(F.array_join(F.transform("kids", lambda x: hexed(x["hash"])), "")))
        runs = materialize(runs.withColumns({"parent_level": F.lit(base + k), "parent_at": F.col("start") + F.col("up") * FAN**k}))

        def joined(some: Column) -> Column:
            return F.aggregate(some, F.lit(b""), lambda a, x: F.concat(a, x["hash"]))

        def node(x: Column, i: Column) -> Column:
            before, after = (joined(F.slice("kids", a, b)) for a, b in ((F.lit(1), i), (i + 2, F.lit(FAN))))
            return F.struct(x["level"].alias("level"), x["at"].alias("at"), before.alias("before"), after.alias("after"))

        linked = runs.select("parent_level", "parent_at", F.explode(F.transform("kids", node)).alias("x"))
        nodes.append(linked.select("x.level", "x.at", "parent_level", "parent_at", "x.before", "x.after"))
        rows = runs.select(F.col("parent_level").alias("level"), F.col("parent_at").alias("at"), F.col("up").alias("pos"), "start", "height", "hash")
        tops.append(rows.where(F.col("height") == k).select(*key))
    return nodes, reduce(DataFrame.union, tops)


def build_manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Leaves, sources, nodes and root; changed: the digest that verification starts from instead of the leaf, if there is another."""
    spark = docs.sparkSession
    with discarding(spark):
        hashed = docs.select("source", "doc_id", leaf().alias("leaf"), (leaf() if changed is None else changed).alias("changed"))
        counted = hashed.groupBy("source", "doc_id", "leaf", "changed").agg(F.count("*").alias("copies"))
        placed = materialize(each_copy(numbered(counted, ["source", "doc_id", "leaf"], "copies"), "copies"))
        starts = placed.groupBy("source").agg(F.min("at").alias("start"), F.count("*").alias("n"))
        starts = numbered(starts.withColumn("one", F.lit(1)), ["source"], "one").drop("one").withColumnRenamed("at", "number")
        starts = materialize(starts.withColumn("height", height(F.col("n"))))
        own = starts.select(F.col("source").alias("of"), "start", "height")
        leaves = materialize(placed.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of"))
        foot = leaves.select(F.lit(0).alias("level"), "at", (F.col("at") - F.col("start")).alias("pos"), "start", "height", F.col("leaf").alias("hash"))
        nodes, tops = grow(foot, 0)
        subroots = materialize(tops.join(starts.drop("height"), "start"))
        all_sources = height(F.lit(subroots.count()))
        feet = subroots.select("level", "at", F.col("number").alias("pos"), F.lit(0).cast("long").alias("start"), all_sources.alias("height"), "hash")
        above, tops = grow(feet, ROOT)
        root = tops.first()
        none = spark.createDataFrame([], "level int, at long, parent_level int, parent_at long, before binary, after binary")
        sources = subroots.select("source", "number", "start", "n", F.col("hash").alias("subroot"))
        kept = leaves.select("at", "start", "doc_id", "source", "leaf", "changed"), sources, reduce(DataFrame.union, nodes + above, none)
        paths = [scratch(spark, "table") for _ in kept]
        for df, path in zip(kept, paths):
            df.write.parquet(path)
    stored = [spark.read.schema(df.schema).parquet(path) for df, path in zip(kept, paths)]
    return Manifest(*stored, *((bytes(root["hash"]), root["level"]) if root else (None, 0)))


@contextmanager
def _unlimited(spark: SparkSession):
    """Recursion without the row limit that guards interactive queries: its steps are bounded by the height of the trees."""
    before = {name: spark.conf.get(name) for name in LIMITS}
    try:
        for name, value in LIMITS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


CLIMB = """
with recursive climb(leaf_at, level, at, folded, siblings) as (
  select leaf_at, level, at, folded, cast('' as binary) as siblings from {feet}
  union all
  select c.leaf_at, n.parent_level, n.parent_at,
    unhex(sha2(concat(lower(hex(n.before)), lower(hex(c.folded)), lower(hex(n.after))), 256)), concat(n.before, n.after)
  from climb c join {nodes} n on c.level = n.level and c.at = n.at
)
select leaf_at, level, at, folded, siblings from climb
"""


def climb(feet: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaf_at, level, at, folded, siblings) of each leaf at each node that it reaches by these node rows, its start included."""
    return feet.sparkSession.sql(CLIMB, feet=feet, nodes=nodes)


def upper_level(nodes: DataFrame, most: int) -> int:
    """The lowest level of the upper part: the tree over the sources from its top, then the sources' own, as long as their nodes
    are at most so many together."""
    counts = {r.level: r.n for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}  # at most ROOT + 40 rows
    lowest, total = 2 * ROOT, 0
    for level in sorted(counts, reverse=True):
        total += counts[level]
        if total > most:
            break
        lowest = level
    return lowest


def verify(manifest: Manifest, most: int = UPPER_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row, digests as hex text. Stored: the recursion
    runs here, without limits on its rows."""
    leaves, root = manifest.leaves, F.lit(manifest.root)
    spark = leaves.sparkSession
    lowest = upper_level(manifest.nodes, most)
    with _unlimited(spark), discarding(spark):
        lower, upper = (manifest.nodes.where(x) for x in (F.col("level") < lowest, F.col("level") >= lowest))
        feet = leaves.select(F.col("at").alias("leaf_at"), F.lit(0).alias("level"), "at", F.col("changed").alias("folded"))
        reached, steps = feet, []
        if lowest:
            below = materialize(climb(feet, lower))
            steps.append(below)
            reached = below.where(F.col("level") >= lowest).drop("siblings")
        steps.append(climb(reached, materialize(upper)))
        at_root = F.when(F.col("level") == manifest.root_level, F.col("folded")).alias("folded")
        passed = reduce(DataFrame.union, steps).select("leaf_at", "level", "siblings", at_root)
        path = F.sort_array(F.collect_list(F.struct("level", "siblings"))).alias("path")
        proofs = passed.groupBy("leaf_at").agg(path, F.max("folded").alias("folded"))
        proof = F.sha2(F.array_join(F.transform("path", lambda x: hexed(x["siblings"])), "").cast("binary"), 256)
        proofs = proofs.select(F.col("leaf_at").alias("at"), proof.alias("proof_sha256"), "folded")
        named = leaves.select("at", "start", "doc_id", "leaf").join(proofs, "at").join(manifest.sources.select("start", "subroot"), "start")
        same = (F.col("folded") == root).alias("verified")
        digests = [hexed(c).alias(n) for c, n in ((F.col("leaf"), "leaf"), (F.col("subroot"), "subroot"), (root, "root"))]
        found = named.select("doc_id", *digests, "proof_sha256", hexed(F.col("folded")).alias("folded_root"), same)
        path_out = scratch(spark, "manifest")
        found.write.parquet(path_out)
    return spark.read.schema(found.schema).parquet(path_out)


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    manifest = build_manifest(docs, tampered_leaf())
    found = verify(manifest)
    discard(manifest.leaves, manifest.sources, manifest.nodes)
    return found


_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS) + ")"
#: SQL has no checksum of this kind: eight steps for each byte, by its polynomial.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, (d & 1) * 3988292384))))"""
_FOLD_SQL = "sha256(array_to_string(r.nodes[1:c.pos % 3], '') || c.folded || array_to_string(r.nodes[c.pos % 3 + 2:], ''))"
_PASSED_SQL = "c.proof || array_to_string(r.nodes[1:c.pos % 3], '') || array_to_string(r.nodes[c.pos % 3 + 2:], '')"
OP12_SQL = f"""
with recursive hashed as (
  select *, {_LEAF_SQL} as leaf, case when {_CRC_SQL} % 2 = 0 then {_LEAF_SQL.replace("text::varchar", "replace(text, chr(10), '')")} else {_LEAF_SQL} end as changed
  from documents
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by source nulls first) - 1 as number, row_number() over () as id from hashed
), sizes as (
  select number, n, (select min(k) from range(0, 40) t(k) where pow(3, k) >= n) as height from (select number, count(*) as n from placed group by number)
), tree(number, level, pos, hash) as (
  select number, 0, pos, leaf from placed
  union all
  select t.number, level + 1, pos // 3, sha256(string_agg(hash, '' order by pos)) from tree t join sizes s on t.number = s.number
  where level < height group by t.number, level, pos // 3
), subroots as (select number, hash from tree t join sizes s using (number) where level = height
), most as (select (select min(k) from range(0, 40) t(k) where pow(3, k) >= n) as height from (select count(*) as n from subroots)
), top(level, pos, hash) as (
  select 0, number, hash from subroots
  union all
  select level + 1, pos // 3, sha256(string_agg(hash, '' order by pos)) from top, most where level < height group by level, pos // 3
), runs as (select number, level, pos // 3 as run, list(hash order by pos) as nodes from tree group by 1, 2, 3
), top_runs as (select level, pos // 3 as run, list(hash order by pos) as nodes from top group by 1, 2
), climb(id, number, level, pos, folded, proof) as (
  select id, number, 0, pos, changed, '' from placed
  union all
  select c.id, c.number, c.level + 1, c.pos // 3, {_FOLD_SQL}, {_PASSED_SQL}
  from climb c join sizes s on c.number = s.number join runs r on r.number = c.number and r.level = c.level and r.run = c.pos // 3 where c.level < s.height
), ended as (select c.* from climb c join sizes s on c.number = s.number and c.level = s.height
), rise(id, level, pos, folded, proof) as (
  select id, 0, number, folded, proof from ended
  union all
  select c.id, c.level + 1, c.pos // 3, {_FOLD_SQL}, {_PASSED_SQL} from rise c join most on c.level < most.height join top_runs r on r.level = c.level and r.run = c.pos // 3
), root as (select hash from top join most on top.level = most.height
)
select p.doc_id, p.leaf, s.hash as subroot, root.hash as root, sha256(c.proof) as proof_sha256, c.folded as folded_root, c.folded = root.hash as verified
from placed p join subroots s on s.number = p.number join rise c on c.id = p.id join most on c.level = most.height, root
"""
