"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard.

Vectors are dealt to shards of about SHARD_ROWS by a hash. In a shard, each
vector's neighbours are proposed by greedy beam searches and pruned: the nearest
proposal is kept, and proposals that it is nearer to by the factor ALPHA than the
vector is are dropped, which keeps diverse edges (Vamana; Subramanya et al.).
Queries search every shard with a beam, in blocks, and the answers are merged.

A node is a direction: a vector divided by its largest magnitude. Division is
rounded correctly, so multiples of a vector have one node, and very large or small
components neither overflow nor vanish. A node has its ids beside it, of which only
the k + 1 least are carried, all that k answers can use. Graphs are built and
searched in single precision; the score of what a search finds is the cosine in
double precision, its sums taken in the order of the components.

A shard is one row of the index, of a size that SHARD_ROWS bounds. A block of
queries, which BLOCK_QUERIES bounds, is broadcast, and each shard is searched where
it is read, so the index is never shuffled or copied for a query. The work is that
of the stated query set against every shard.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without id; vectors of different lengths
are not compared; an id repeated with the same vector counts once, and with
several vectors by its nearest; rows with the query's own id are no candidates;
ties go to the smaller id; an empty table gives an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import forget_at_exit, gather, scratch_path, written

SHARD_ROWS, BLOCK_QUERIES = 16384, 16384
#: Neighbours that pruning leaves, and that a node may hold before it is pruned again.
DEGREE, CAPACITY = 24, 36
ALPHA, BUILD_BEAM, SEARCH_BEAM, EXPAND, STARTS, BATCH = 1.2, 48, 128, 6, 4, 256
_TYPES = {"ids": np.int64, "id_ends": np.int64, "vectors": np.float64, "graph": np.int32, "starts": np.int32}


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in single precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scalar products of rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def beam_search(data: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the `width` most similar nodes that each query comes upon, best first; -1 where there are fewer."""
    b, n = len(queries), len(data)
    nodes = np.full((b, width), -1, np.int32)
    near = np.full((b, width), -np.inf, np.float32)
    opened = np.zeros((b, width), bool)
    seen = np.zeros((b, n), bool)
    starts = np.unique(starts)[:width]
    nodes[:, : len(starts)], near[:, : len(starts)], seen[:, starts] = starts, queries @ data[starts].T, True
    rows = np.arange(b)
    while len(rows):
        left = np.where(opened[rows] | (nodes[rows] < 0), -np.inf, near[rows])
        pick = np.argsort(-left, axis=1, kind="stable")[:, :EXPAND]
        chosen = np.take_along_axis(left, pick, 1) > -np.inf
        busy = chosen.any(axis=1)
        rows, pick, chosen = rows[busy], pick[busy], chosen[busy]
        if not len(rows):
            break
        mark = opened[rows]
        np.put_along_axis(mark, pick, np.take_along_axis(mark, pick, 1) | chosen, 1)
        opened[rows] = mark
        out = graph[np.where(chosen, np.take_along_axis(nodes[rows], pick, 1), 0)]
        out = np.where(chosen[:, :, None], out, -1).reshape(len(rows), -1)
        out = np.sort(out, axis=1)
        fresh = (out >= 0) & ~seen[rows[:, None], np.maximum(out, 0)]
        fresh[:, 1:] &= out[:, 1:] != out[:, :-1]
        at, which = np.nonzero(fresh)
        found = out[at, which]
        seen[rows[at], found] = True
        score = np.full(out.shape, -np.inf, np.float32)
        score[at, which] = np.einsum("ij,ij->i", queries[rows[at]], data[found])
        all_nodes = np.concatenate([nodes[rows], np.where(fresh, out, -1)], axis=1)
        all_near = np.concatenate([near[rows], score], axis=1)
        all_opened = np.concatenate([opened[rows], np.zeros(out.shape, bool)], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        nodes[rows], near[rows], opened[rows] = (np.take_along_axis(x, best, 1) for x in (all_nodes, all_near, all_opened))
    return nodes, near


def robust_prune(data: np.ndarray, of: np.ndarray, proposals: np.ndarray) -> np.ndarray:
    """For each node, DEGREE of its proposals (-1: none) that aren't made needless by a nearer one."""
    proposals = np.sort(proposals, axis=1)
    bad = (proposals < 0) | (proposals == of[:, None])
    bad[:, 1:] |= proposals[:, 1:] == proposals[:, :-1]
    vectors = data[np.maximum(proposals, 0)]
    away = np.where(bad, np.inf, 2 - 2 * np.einsum("bcd,bd->bc", vectors, data[of]))
    order = np.argsort(away, axis=1, kind="stable")
    away, proposals = np.take_along_axis(away, order, 1), np.take_along_axis(proposals, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = away < np.inf
    kept = np.full((len(of), CAPACITY), -1, np.int32)
    each = np.arange(len(of))
    for k in range(DEGREE):
        first = np.argmax(alive, axis=1)
        some = alive[each, first]
        if not some.any():
            break
        kept[some, k] = proposals[some, first[some]]
        alive &= ~(some[:, None] & (ALPHA**2 * between[each, first] <= away))
        alive[each, first] = False
    return kept


def build_graph(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each node, nodes at which searches begin) of unit vectors.

    Nodes are added in random order, in batches that double up to BATCH: each searches the graph of those before,
    takes what pruning leaves of the proposals and of its batch's nearest, and is linked back.
    """
    n = len(data)
    rng = np.random.default_rng(seed)
    graph = np.full((n, CAPACITY), -1, np.int32)
    order = rng.permutation(n).astype(np.int32)
    starts = order[: STARTS + 1]
    at = 0
    while at < n:
        own = order[at : at + min(max(at, STARTS + 1), BATCH)]
        near = data[own] @ data[own].T
        np.fill_diagonal(near, -np.inf)
        peers = own[np.argsort(-near, axis=1)[:, : DEGREE // 2]]
        proposals = [peers, graph[own]]
        if at:
            proposals.append(beam_search(data, graph, starts, data[own], BUILD_BEAM)[0])
        graph[own] = robust_prune(data, own, np.concatenate(proposals, axis=1))
        _link_back(data, graph, own)
        at += len(own)
    return graph, starts


def _link_back(data: np.ndarray, graph: np.ndarray, own: np.ndarray) -> None:
    """Adds the edges back from the neighbours of `own`; a node whose room runs out is pruned first."""
    source, target = np.repeat(own, CAPACITY), graph[own].ravel()
    source, target = source[target >= 0], target[target >= 0]
    while len(source):
        new = ~(graph[target] == source[:, None]).any(axis=1)
        source, target = source[new], target[new]
        if not len(source):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        place = (graph[target] >= 0).sum(axis=1) + rank
        room = place < CAPACITY
        graph[target[room], place[room]] = source[room]
        source, target = source[~room], target[~room]
        full = np.unique(target)
        if len(full):
            spare = np.full((len(full), 1), -1)
            one = np.searchsorted(target, full)  # each full node considers one of its waiting edges at least
            spare[:, 0] = source[one]
            graph[full] = robust_prune(data, full, np.concatenate([graph[full], spare], axis=1))
            waiting = np.ones(len(source), bool)
            waiting[one] = False
            source, target = source[waiting], target[waiting]


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0)


def direction(vector: Column) -> Column:
    """A vector divided by its largest magnitude: the same for all its positive multiples."""
    return F.transform(vector, lambda x: x / F.array_max(F.transform(vector, lambda y: F.abs(y))) + F.lit(0.0))  # no negative zeros


def rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the usable vectors' directions."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", direction(F.col("vector")).alias("vector"))


def nodes_of(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(vector, ids): the distinct directions, each with its k + 1 least ids. Ranks are limited before they are shuffled."""
    rows = rows_of(vectors, id_col, vector_col).distinct()
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("place") <= k + 1)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def build_index(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index, one row for each shard: size of its vectors, shard, and as bytes its nodes' ids and where they end, vectors, graph and starts."""
    nodes = written(nodes_of(vectors, k, id_col, vector_col), "nodes")
    counts = nodes.groupBy(F.size("vector").alias("size")).agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("long").alias("shards"))
    sharded = nodes.withColumn("size", F.size("vector")).join(F.broadcast(counts), "size")  # a row for each length of vectors
    sharded = sharded.select("size", F.pmod(F.xxhash64("vector"), "shards").alias("shard"), "ids", "vector")

    def build(key, table):
        raw, ids = _matrix(table.column("vector"), key[0].as_py()), table.column("ids").combine_chunks()
        order = np.lexsort(raw.T[::-1])  # the same graph whatever order rows come in
        graph, starts = build_graph(unit(raw[order]), seed=int(key[1].as_py()) & 0x7FFFFFFF)
        ids = ids.take(pa.array(order))
        made = {"ids": ids.flatten(), "id_ends": np.cumsum(np.asarray(pa.compute.list_value_length(ids))), "vectors": raw[order], "graph": graph, "starts": starts}
        packed = [pa.array([np.ascontiguousarray(np.asarray(made[n]), t).tobytes()], pa.binary()) for n, t in _TYPES.items()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *packed], ["size", "shard", *_TYPES])

    made = sharded.groupBy("size", "shard").applyInArrow(build, "size int, shard long, " + ", ".join(f"{n} binary" for n in _TYPES))
    return written(made, "graph")


def _matrix(column, size: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), np.float64).reshape(-1, size)


def search_shard(shard: dict, queries: tuple[np.ndarray, np.ndarray], k: int, beam: int) -> list[np.ndarray]:
    """[query ids, ids, scores] of the k nearest that each query finds in a shard."""
    own, asked = queries
    ids, ends, vectors, graph, starts = (np.frombuffer(shard[n], t) for n, t in _TYPES.items())
    vectors = vectors.reshape(-1, shard["size"])
    data, graph = unit(vectors), graph.reshape(-1, CAPACITY)
    begins, counts = np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends]))
    norms = np.sqrt(dots(vectors, vectors))
    out = []
    for at in range(0, len(asked), BATCH):
        asks = asked[at : at + BATCH]
        found, _ = beam_search(data, graph, starts, unit(asks), max(beam, k + 1))
        who, col = np.nonzero(found >= 0)
        node = found[who, col]
        score = dots(vectors[node], asks[who]) / (norms[node] * np.sqrt(dots(asks, asks))[who])
        many = counts[node]
        one = gather(begins[node], many)
        who, score, vec = np.repeat(who, many), np.repeat(score, many), ids[one]
        other = vec != own[at + who]
        who, score, vec = who[other], score[other], vec[other]
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append([own[at + who[best]], vec[best], score[best]])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row (query_id, vector) of queries."""
    spark = index.sparkSession
    asked = rows_of(queries, "query_id", "vector").withColumn("size", F.size("vector")).distinct()
    asked = written(asked, "queries")
    blocks = max(1, -(-asked.count() // block_queries))
    blocked = written(asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))), "blocks") if blocks > 1 else asked.withColumn("block", F.lit(0))

    def searched(block: int) -> DataFrame:
        held = blocked.filter(F.col("block") == block).select("size", "id", "vector").toArrow()  # about block_queries rows
        by_size = {size: held.filter(pa.compute.equal(held.column("size"), size)) for size in pa.compute.unique(held.column("size")).to_pylist()}
        sent = spark.sparkContext.broadcast({size: (np.asarray(t.column("id")), _matrix(t.column("vector"), size)) for size, t in by_size.items()})

        def search(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = {n: batch.column(batch.schema.get_field_index(n))[i].as_buffer() for n in _TYPES} | {"size": batch.column(batch.schema.get_field_index("size"))[i].as_py()}
                    if shard["size"] in sent.value:
                        found = search_shard(shard, sent.value[shard["size"]], k, beam)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        return index.select("size", *_TYPES).mapInArrow(search, "query_id long, vec_id long, score double")

    found = searched(0)
    if blocks > 1:
        path = scratch_path(spark, "found")
        for block in range(blocks):
            searched(block).write.mode("append").parquet(path)
        forget_at_exit(spark, path)
        found = spark.read.schema(found.schema).parquet(path)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The columns that op4 returns: queries are the rows whose vec_id is divisible by `every`."""
    index = build_index(vectors, k, shard_rows=shard_rows)
    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search_index(index, asked, k, block_queries=block_queries)


#: Brute force, which a graph equals where it finds all.
ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (
  SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM r
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
d AS (SELECT DISTINCT vec_id, list_transform(e, lambda x: x / m) AS v FROM u WHERE m > 0),
n AS (SELECT vec_id, v, len(v) AS size, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM d),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(c.v, q.v), lambda x: x[1] * x[2])) / (c.norm * q.norm)) AS score
  FROM n q JOIN n c ON q.size = c.size AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""
