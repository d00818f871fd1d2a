"""Exact top-k by inner product: a KD-tree per shard, searched best box first.

Shards are the leaves of a KD-tree over a bounded sample, so that every row has one shard and the shards have tight
boxes. A box bounds the inner product of a query by the sum of max(q*low, q*high). A query is first searched in the
shard with the best bound; the k-th score that it finds there goes along to the others, and only shards whose bound
reaches it are visited. Inside a shard the tree goes on with median splits and tight boxes; every query walks its leaves
best bound first and stops when the bound falls below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Rows of a shard; shards at most (beyond it they grow, and are cut into pieces of SHARD rows); queries of a block; rows of a leaf.
SHARD, SHARDS, QUERIES_IN_BLOCK, LEAF = 4096, 4096, 4096, 128
#: Rows of the sample that the shards are cut by, for each shard and at most.
SAMPLE, SAMPLES = 64, 100_000


def _leaves(x: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves; a split puts half of the rows on each side, ties included."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        side = np.argmax(x[at].max(0) - x[at].min(0))
        order = np.argpartition(x[at, side], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


class Cuts:
    """A KD-tree of `shards` leaves by medians of a sample; shard() gives the leaf of each row."""

    def __init__(self, x: np.ndarray, shards: int):
        self.side, self.cut, self.left, self.right, self.leaves = [], [], [], [], 0
        self._grow(x, shards)

    def _grow(self, x: np.ndarray, shards: int) -> int:
        """Number of the node, or -1 - leaf."""
        if shards <= 1 or len(x) < 2:
            self.leaves += 1
            return -self.leaves
        side = int(np.argmax(x.max(0) - x.min(0)))
        cut = float(np.partition(x[:, side], len(x) * (shards // 2) // shards)[len(x) * (shards // 2) // shards])
        node = len(self.side)
        self.side.append(side)
        self.cut.append(cut)
        self.left.append(0)
        self.right.append(0)
        below = x[:, side] < cut
        self.left[node] = self._grow(x[below], shards // 2)
        self.right[node] = self._grow(x[~below], shards - shards // 2)
        return node

    def shard(self, x: np.ndarray) -> np.ndarray:
        if not self.side:
            return np.zeros(len(x), np.int64)
        side, cut, left, right = map(np.array, (self.side, self.cut, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        while (live := np.flatnonzero(node >= 0)).size:
            own = node[live]
            node[live] = np.where(x[live, side[own]] < cut[own], left[own], right[own])
        return -1 - node


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query number, vec_id, score of the k best of x for each q: higher score first, then smaller id; never the own id.

    With `least`, only scores that reach the query's are looked for; an equal one can still have a smaller id.
    """
    leaves = _leaves(x)
    low, high = np.array([x[a].min(0) for a in leaves]), np.array([x[a].max(0) for a in leaves])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, best_id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    kth = np.full(len(q), -np.inf) if least is None else least.astype(float)
    live = np.arange(len(q))
    for step in range(len(leaves)):
        leaf = order[live, step]
        live = live[bounds[live, leaf] >= np.maximum(best[live, -1], kth[live])]  # an equal bound can still hold a smaller id
        leaf = order[live, step]
        if not len(live):
            break
        for b in np.unique(leaf):
            who, rows = live[leaf == b], leaves[b]
            score = q[who] @ x[rows].T
            score[query_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            score[score < kth[who][:, None]] = -np.inf
            both = np.concatenate([best[who], score], 1)
            names = np.concatenate([best_id[who], np.broadcast_to(ids[rows], score.shape)], 1)
            pick = np.lexsort((names, -both), axis=1)[:, :k]
            best[who], best_id[who] = np.take_along_axis(both, pick, 1), np.take_along_axis(names, pick, 1)
    at, place = np.nonzero(np.isfinite(best))
    return at, best_id[at, place], best[at, place]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.empty((0, 1))


def _visited(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score from shards: asked has id, v, dims, shard and least (the score to reach).

    Queries of a shard are cut into blocks; the shard's rows go to each block of their own shard only, and a shard
    that is larger than planned is cut into pieces by hash.
    """
    blocks = asked.groupBy("dims", "shard").agg(F.ceil(F.count("*") / QUERIES_IN_BLOCK).alias("blocks"))
    pieces = rows.groupBy("dims", "shard").agg(F.ceil(F.count("*") / (2 * SHARD)).alias("pieces"))
    plan = written(blocks.join(pieces, ["dims", "shard"]), "knn_plan")
    keys = ["dims", "shard", "piece", "block"]
    data = rows.join(F.broadcast(plan), ["dims", "shard"]).withColumn("piece", F.pmod(F.xxhash64("id", "v"), "pieces"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(*keys, "id", "v")
    own = asked.join(F.broadcast(plan), ["dims", "shard"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks"))
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).select(*keys, "id", "v", "least")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        at, ids, score = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        if len(left) and len(right):
            at, ids, score = search(left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k, right.column("least").to_numpy())
        return pa.table({"query_id": right.column("id").to_numpy()[at] if len(right) else ids, "vec_id": ids, "score": score.astype(np.int64)})

    return data.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(one, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score over floor(scale * component), exact while sums stay below 2^53.

    Rows without an id, with a null or empty vector, or with a null or non-finite component take no part.
    Vectors of other lengths than the query's are no candidates. A row with the query's own id is never its
    candidate; repeated ids count as repeated candidates, and queries with one id (and different vectors) give the
    best of all of them. Without candidates a query has no rows. The sample and the boxes of the shards, which are
    all that is broadcast, have at most SAMPLES and SHARDS rows for each length of vectors.
    """
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = written(vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vec_col).alias("dims"), is_query.alias("is_query")), "knn_rows")
    sizes = {r.dims: r.n for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    cuts = {}
    for dims, n in sizes.items():
        shards = min(-(-n // SHARD), SHARDS)
        share = min(1.0, min(SAMPLES, 2 * SAMPLE * shards) / n)
        sample = rows.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < int(share * (1 << 20)))).select("v").limit(2 * SAMPLES).toArrow()
        cuts[dims] = Cuts(_matrix(sample.column("v")), shards)

    def dealt(batches):
        for b in batches:
            shard = np.zeros(len(b), np.int64)
            kinds = b.column("dims").to_numpy()
            for dims in np.unique(kinds):
                at = np.flatnonzero(kinds == dims)
                shard[at] = cuts[int(dims)].shard(_matrix(b.column("v").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "v", "dims", "is_query")), pa.array(shard)], names=["id", "v", "dims", "is_query", "shard"])

    held = written(rows.mapInArrow(dealt, "id long, v array<double>, dims int, is_query boolean, shard long"), "knn_shards")
    dropped(rows)
    side = held.select("dims", "shard", F.posexplode("v").alias("i", "x")).groupBy("dims", "shard", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes: dict[int, tuple] = {}
    found = side.groupBy("dims", "shard").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("box")).collect()
    for dims in sizes:
        own = [r for r in found if r.dims == dims]
        boxes[dims] = np.array([r.shard for r in own]), np.array([[x.low for x in r.box] for r in own]), np.array([[x.high for x in r.box] for r in own])
    queries = written(held.filter("is_query").select("id", "v", "dims").dropDuplicates(["id", "v"]), "knn_queries")
    data = held.select("id", "v", "dims", "shard")

    def routed(first: bool):
        """id, v, dims, shard, least: each query with the shard of its best bound, or with the others that reach its k-th score."""

        def run(batches):
            for b in batches:
                kinds, least = b.column("dims").to_numpy(), b.column("least").to_numpy()
                rows_, shards = [], []
                for dims in np.unique(kinds):
                    at = np.flatnonzero(kinds == dims)
                    names, low, high = boxes[int(dims)]
                    q = _matrix(b.column("v").take(pa.array(at)))
                    for i in range(0, len(at), 256):
                        bound = np.maximum(q[i : i + 256], 0) @ high.T + np.minimum(q[i : i + 256], 0) @ low.T
                        best = bound.argmax(1)
                        if first:
                            rows_.append(at[i : i + 256])
                            shards.append(names[best])
                        else:
                            bound[np.arange(len(best)), best] = -np.inf
                            r, s = np.nonzero((bound >= least[at[i : i + 256]][:, None]) & np.isfinite(bound))
                            rows_.append(at[i : i + 256][r])
                            shards.append(names[s])
                pick = pa.array(np.concatenate([*rows_, np.empty(0, int)]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in ("id", "v", "dims")), pa.array(np.concatenate([*shards, np.empty(0, np.int64)])), b.column("least").take(pick)], names=["id", "v", "dims", "shard", "least"])

        return run

    kind = "id long, v array<double>, dims int, shard long, least double"
    none = queries.withColumn("least", F.lit(float("-inf")))
    near = written(_visited(data, written(none.mapInArrow(routed(True), kind), "knn_first"), k), "knn_near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A query with fewer than k found has no score to reach; one that stands for several vectors is judged by each.
    scores = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    single = queries.groupBy("id").agg(F.count("*").alias("vectors")).filter("vectors = 1").select("id")
    known = queries.join(scores.join(single, "id"), "id", "left").select("id", "v", "dims", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    far = _visited(data, written(known.mapInArrow(routed(False), kind), "knn_others"), k)
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op7_knn": op7_knn}
SQL = {
    "op7_knn": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as e from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""
}
