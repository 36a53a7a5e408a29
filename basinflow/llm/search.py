"""Exact top-k inner products by norm buckets with local cosine thresholds.

Vectors are dealt to buckets by falling length. A query walks the buckets from the longest vectors on; its k-th best product so
far, divided by the lengths, is the cosine that a vector of the bucket must reach. Above 1 the bucket is skipped; near 1 the
query's largest coordinates bound where the vector's coordinates can lie, and only vectors inside all bounds are multiplied; else
lengths alone bound which part of the bucket can matter. All products that decide are exact integers.

Queries stand in blocks, buckets in groups by falling length. Every block first meets the group of the longest vectors, which gives
each query a threshold; then a block meets, one task each, only the groups that are long enough for one of its queries to gain.
What moves is packed matrices of the narrowest integers, and at most k rows for each query and group. The driver holds one length
for each group.

Defined cases: vectors null or with null or non-finite components take no part; shorter vectors end in zeros; every row is a
candidate, also where rows repeat a vec_id, but for those with the query's own vec_id; rows that repeat a query's vec_id share its
k best; a null vec_id takes no part; an empty table gives no rows; ties go to the smaller vec_id. Other columns are not looked at.
Products must stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinflow.llm.common import materialize
from basinflow.session import ship

K, QUERY_EVERY = 20, 20
SCALE = 64
BUCKET_ROWS, QUERY_ROWS, GROUP_BUCKETS = 2048, 16384, 8
#: From this local cosine on, coordinates prune better than lengths; so many of the query's largest are used.
COORDINATE_COSINE, FOCUS = 0.9, 3
PACKED = "block long, n long, width long, ids binary, data binary, type string, longest double"
#: First meeting: the block with its thresholds and the last group it needs, and rows found, which have no block.
MET = "query_id long, vec_id long, score long, block long, n long, width long, ids binary, data binary, type string, floors binary, upto int"


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v: array<long> of every row that takes part."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


def _narrow(data: np.ndarray) -> np.ndarray:
    most = int(np.abs(data).max(initial=0))
    return data.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _pack(rows: int):
    """Rows of a partition as matrices of at most so many rows, in their order; blocks are numbered by partition, then place."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        made, held = 0, []

        def flush(held: list[tuple]) -> pd.DataFrame:
            nonlocal made
            width = max((len(v) for _, v in held), default=0)
            data = _matrix([v for _, v in held], width)
            longest = float(np.sqrt((data.astype(float) ** 2).sum(axis=1)).max(initial=0.0))
            block = (TaskContext.get().partitionId() << 32) + made
            made += 1
            data = _narrow(data)
            return pd.DataFrame([(block, len(held), width, np.array([i for i, _ in held], np.int64).tobytes(), data.tobytes(), data.dtype.str, longest)], columns=_names(PACKED))

        for batch in batches:
            for item in zip(batch["vec_id"], batch["v"]):
                held.append(item)
                if len(held) == rows:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return pack


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.data, row.type).reshape(int(row.n), int(row.width)).astype(np.int64)


class TopK:
    """Best products of a block of queries so far, with the buckets walked through it."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]  # scores, vec_ids
        self.floor = np.full(len(ids), -(2.0**62)) if floor is None else floor.copy()
        self.pruned = {"length": 0, "coordinate": 0, "product": 0}

    def _keep(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = ids == self.ids[row]
        if own.any():
            scores, ids = scores[~own], ids[~own]
        scores, ids = np.append(self.best[row][0], scores), np.append(self.best[row][1], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[row] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[row] = scores[order[-1]]

    def need(self) -> float:
        """The length that a vector must have for any of the queries to gain by it."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.where(self.floor > 0, self.floor / np.maximum(self.lengths, 1e-300), -1.0).min(initial=np.inf)) * (1 - 1e-9)

    def found(self) -> dict[str, np.ndarray]:
        sizes = [len(ids) for _, ids in self.best]
        return {"query_id": np.repeat(self.ids, sizes), "vec_id": np.concatenate([i for _, i in self.best]), "score": np.concatenate([s for s, _ in self.best])}

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        queries, vectors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.queries, vectors))
        floats = vectors.astype(float)
        lengths = np.sqrt((floats**2).sum(axis=1))
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * width
        exact = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        slack = 1 + 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.floor > 0, self.floor / (self.lengths * lengths.max(initial=0) * slack), -1.0)
        cosine = np.nan_to_num(cosine, nan=2.0, posinf=2.0)
        self.pruned["length"] += int((cosine > 1).sum())
        by_coordinate = np.flatnonzero((cosine <= 1) & (cosine >= COORDINATE_COSINE))
        unit = floats / np.maximum(lengths, 1e-300)[:, None] if len(by_coordinate) else floats
        for row in by_coordinate:
            self.pruned["coordinate"] += 1
            q, t = queries[row] / self.lengths[row], cosine[row]
            inside = lengths * self.lengths[row] * slack >= self.floor[row]
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                # Two unit vectors of cosine t or more: this coordinate lies within the cap around the query's.
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f]))) + 1e-9
                low = q[f] * t - spread if q[f] > -t else -1.0
                high = q[f] * t + spread if q[f] < t else 1.0
                inside &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
            near = np.flatnonzero(inside)
            if len(near):
                scores = (vectors[near].astype(exact) @ queries[row].astype(exact)).astype(np.int64)
                good = scores >= self.floor[row]
                self._keep(row, scores[good], ids[near[good]])
        rows = np.flatnonzero(cosine < COORDINATE_COSINE)
        self.pruned["product"] += len(rows)
        cast = vectors.astype(exact)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            # Buckets are in order of falling length, so lengths leave a prefix.
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.floor[some] > 0, self.floor[some] / np.maximum(self.lengths[some], 1e-300), -1.0).min(initial=np.inf)
            upto = int((lengths * slack >= need).sum())
            scores = (queries[some].astype(exact) @ cast[:upto].T).astype(np.int64)
            if upto > self.k + 1:
                least = np.partition(scores, upto - self.k - 1, axis=1)[:, upto - self.k - 1]
                least = np.maximum(least, self.floor[some])
            else:
                least = self.floor[some]
            for row, line, floor in zip(some, scores, least):
                good = np.flatnonzero(line >= floor)
                if len(good):
                    self._keep(row, line[good], ids[good])


def top_k(rows: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for every query, a row whose vec_id is divisible by `every`, against all other rows."""
    spark = rows.sparkSession
    ship(spark)
    vectors = materialize(integer_vectors(rows))
    n = vectors.count()
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    parts = max(1, -(-n // (BUCKET_ROWS * GROUP_BUCKETS)))
    # A row's place in its file tells rows apart that are equal otherwise.
    ordered = vectors.withColumn("length", length).withColumn("place", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(parts, F.col("length").desc(), "vec_id", "place").sortWithinPartitions(F.col("length").desc(), "vec_id", "place")
    buckets = materialize(ordered.select("vec_id", "v").mapInPandas(_pack(BUCKET_ROWS), PACKED).withColumn("group", F.shiftright("block", 32).cast("int")))
    asked = vectors.where(F.col("vec_id") % every == 0)
    q_parts = max(1, -(-n // (every * QUERY_ROWS)))
    queries = materialize(asked.repartition(q_parts, F.col("vec_id")).mapInPandas(_pack(QUERY_ROWS), PACKED))
    # Groups without rows have no number here; the first is that of the longest vectors.
    lengths = {r["group"]: r["longest"] for r in buckets.groupBy("group").agg(F.max("longest").alias("longest")).collect()}
    groups = sorted(lengths)
    falling = -np.array([lengths[g] for g in groups])

    def walk(part: pd.DataFrame, floors: bool) -> Iterator[TopK]:
        for query in part[part["group"].isna()].itertuples():
            best = TopK(*_unpacked(query), k, np.frombuffer(query.floors) if floors else None)
            for row in part[part["group"].notna()].sort_values("block").itertuples():
                best.bucket(*_unpacked(row))
            yield query, best

    def first(key, part):
        made = []
        for query, best in walk(part, False):
            made.append(pd.DataFrame(best.found()))
            wanted = int(np.searchsorted(falling, -best.need(), side="right"))
            upto = groups[wanted - 1] if wanted else -1
            made.append(pd.DataFrame({"block": [query.block], "n": [query.n], "width": [query.width], "ids": [query.ids], "data": [query.data], "type": [query.type], "floors": [best.floor.tobytes()], "upto": [upto]}))
        return pd.concat(made).reindex(columns=_names(MET)) if made else pd.DataFrame(columns=_names(MET))

    def later(key, part):
        made = [pd.DataFrame(best.found()) for _, best in walk(part, True)]
        return pd.concat(made) if made else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    fields = ["q", "block", "n", "width", "ids", "data", "type", "group", "floors"]
    none = F.lit(None)
    longest = buckets.where(F.col("group") == (groups[0] if groups else 0)).withColumn("floors", none.cast("binary"))
    blocks = queries.withColumn("q", F.col("block")).withColumn("group", none.cast("int")).withColumn("floors", none.cast("binary"))
    together = blocks.select(*fields).unionByName(longest.join(queries.select(F.col("block").alias("q"))).select(*fields))
    met = materialize(together.groupBy("q").applyInPandas(first, MET))
    held = met.where("block is not null")
    head = groups[0] if groups else 0
    pairs = materialize(held.where(F.col("upto") > head).select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(head + 1), "upto")).alias("g")))
    asking = held.join(pairs, held["block"] == pairs["q"]).withColumn("group", none.cast("int"))
    against = buckets.withColumn("floors", none.cast("binary")).join(pairs, F.col("group") == F.col("g"))
    rest = asking.select(*fields, "g").unionByName(against.select(*fields, "g")).groupBy("q", "g").applyInPandas(later, "query_id long, vec_id long, score long")
    near = met.where("block is null").select("query_id", "vec_id", "score").unionByName(rest)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir):
    from basinflow.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
