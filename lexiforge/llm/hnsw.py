"""Operator 4: approximate nearest neighbours by one HNSW graph per shard.

Equal vectors are one node that holds its least vec_ids, so copies neither break the
graph nor hide each other. Nodes are dealt to shards of about `shard_rows` by a hash;
a shard's graph is stored as flat arrays: neighbours of node i in layer l lie at
a fixed place of an int32 array. Queries go to every shard in blocks; the shards'
best k are merged. Distances are Euclidean over float64 copies of the vectors.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite
component take no part, as rows or as queries; rows without vec_id neither; only
vectors of the query's length are compared; rows that repeat a vec_id with the same
vector are one row, and a query id with several vectors asks with the least; ties go to the smaller vec_id; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch

M = 16
EF_BUILD = 96
EF_SEARCH = 32
SHARD_ROWS = 4096
QUERY_BLOCK = 512
INDEX_SCHEMA = "shard string, dim int, n int, entry int, top int, levels binary, neighbours binary, vectors binary, ids binary, id_from binary"


class Graph:
    """A navigable small-world graph over the rows of `x`; layer l of node i is links[l][i], -1 for none."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.levels, self.links, self.entry = x, levels, links, entry
        self.norm = np.einsum("ij,ij->i", x, x)
        self.seen, self.walk = np.zeros(len(x), np.int64), 0

    def near(self, q: np.ndarray, qq: float, nodes: np.ndarray) -> np.ndarray:
        return self.norm[nodes] - 2.0 * (self.x[nodes] @ q) + qq

    def layer(self, q: np.ndarray, qq: float, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk from `start` finds, as (distance, node) in rising order."""
        self.walk += 1
        links, seen, mark = self.links[level], self.seen, self.walk
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, n) for d, n in start]
        heapq.heapify(best)
        for _, n in start:
            seen[n] = mark
        while ahead:
            d, node = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= ef:
                break
            row = links[node]
            row = row[row >= 0]
            row = row[seen[row] != mark]
            if not len(row):
                continue
            seen[row] = mark
            dist = self.near(q, qq, row)
            if len(best) >= ef:
                keep = dist < -best[0][0]
                row, dist = row[keep], dist[keep]
            for e, n in zip(dist.tolist(), row.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-e, n))
                    heapq.heappush(ahead, (e, n))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, n))
                    heapq.heappush(ahead, (e, n))
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        qq = float(q @ q)
        at = [(float(self.near(q, qq, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            at = self.layer(q, qq, at, 1, level)[:1]
        return self.layer(q, qq, at, max(k, ef), 0)


def _spread(graph: Graph, found: list[tuple[float, int]], most: int) -> list[int]:
    """Neighbours by the diversity rule: a candidate nearer to a chosen one than to the node waits."""
    nodes = np.array([n for _, n in found])
    dist = np.array([d for d, _ in found])
    x = graph.x[nodes]
    gram = graph.norm[nodes][:, None] + graph.norm[nodes][None, :] - 2.0 * (x @ x.T)
    chosen: list[int] = []
    closest = np.full(len(nodes), np.inf)
    for i in range(len(nodes)):
        if closest[i] > dist[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            closest = np.minimum(closest, gram[i])
    picked = set(chosen)
    for i in range(len(nodes)):
        if len(chosen) >= most:
            break
        if i not in picked:
            chosen.append(i)
    return nodes[chosen].tolist()


def build(x: np.ndarray, seed: int = 1, m: int = M, ef: int = EF_BUILD) -> Graph:
    n = len(x)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(m)).astype(np.int32), 8)
    links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(x, levels, links, 0)
    top = int(levels[0]) if n else 0
    for i in range(1, n):
        q, qq = x[i], float(graph.norm[i])
        at = [(float(graph.near(q, qq, np.array([graph.entry]))[0]), graph.entry)]
        for level in range(top, int(levels[i]), -1):
            at = graph.layer(q, qq, at, 1, level)[:1]
        for level in range(min(top, int(levels[i])), -1, -1):
            at = graph.layer(q, qq, at, ef, level)
            width = links[level].shape[1]
            mine = _spread(graph, at, m)
            links[level][i, : len(mine)] = mine
            for other in mine:
                row = links[level][other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    around = np.append(row, i).astype(np.int64)
                    d = graph.near(x[other], float(graph.norm[other]), around)
                    order = np.argsort(d, kind="stable")
                    kept = _spread(graph, list(zip(d[order].tolist(), around[order].tolist())), width)
                    row[:] = -1
                    row[: len(kept)] = kept
        if levels[i] > top:
            top, graph.entry = int(levels[i]), i
    return graph


def valid_vectors(rows: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.where(fine).select("vec_id", x.alias("x"))


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard, as INDEX_SCHEMA."""
    same = Window.partitionBy("x").orderBy("vec_id")
    # k + 1 ids answer every query: its own may be one of them.
    least = rows.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    nodes = least.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = nodes.withColumn("dim", F.size("x"))
    shards = nodes.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).alias("shards"))
    placed = nodes.join(F.broadcast(shards), "dim")  # one row for each vector length
    placed = placed.withColumn("shard", F.concat_ws("-", "dim", F.pmod(F.xxhash64("x"), "shards")))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[ids[0] for ids in pdf["ids"]]).sort_values("first")
        x = np.array(pdf["x"].tolist(), dtype=np.float64)
        graph = build(x)
        ids = np.concatenate([np.asarray(i, np.int64) for i in pdf["ids"]])
        starts = np.concatenate([[0], np.cumsum([len(i) for i in pdf["ids"]])]).astype(np.int32)
        flat = np.concatenate([layer.ravel() for layer in graph.links])
        return pd.DataFrame([[pdf["shard"].iloc[0], x.shape[1], len(x), graph.entry, len(graph.links), graph.levels.tobytes(), flat.tobytes(), x.tobytes(), ids.tobytes(), starts.tobytes()]], columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    return placed.select("shard", "x", "ids").groupBy("shard").applyInPandas(make, INDEX_SCHEMA)


def _load(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    x = np.frombuffer(row.vectors, np.float64).reshape(row.n, row.dim)
    flat, links, at = np.frombuffer(row.neighbours, np.int32), [], 0
    for level in range(row.top):
        width = 2 * M if level == 0 else M
        links.append(flat[at : at + row.n * width].reshape(row.n, width))
        at += row.n * width
    return Graph(x, np.frombuffer(row.levels, np.int32), links, row.entry), np.frombuffer(row.ids, np.int64), np.frombuffer(row.id_from, np.int32)


def search(shards: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each query (query_id, x)."""
    blocks = queries.withColumn("dim", F.size("x")).withColumn("block", F.xxhash64("query_id"))
    sizes = blocks.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    blocks = blocks.join(F.broadcast(sizes), "dim").groupBy("dim", F.pmod("block", "blocks").alias("block")).agg(F.collect_list(F.struct("query_id", "x")).alias("queries"))
    # Each block meets each shard of its vector length; the names of shards are dealt first, so every shard is a task's own.
    names = shards.select("dim", "shard")
    n = max(1, names.count())
    asked = names.join(blocks, "dim").select("shard", "queries").repartition(n, "shard")
    met = shards.drop("dim").withColumn("dim", F.substring_index("shard", "-", 1).cast("int")).repartition(n, "shard").join(asked, "shard")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                graph, ids, starts = _load(row)
                seen = np.zeros(row.n, np.int64)
                out = []
                for nth, query in enumerate(row.queries):
                    q = np.asarray(query["x"], np.float64)
                    found = graph.search(q, k + 1, ef)
                    nodes = np.array([n for _, n in found])
                    dist = np.sqrt(((graph.x[nodes] - q) ** 2).sum(axis=1))
                    mine = [(d, int(v)) for d, n in zip(dist.tolist(), nodes.tolist()) for v in ids[starts[n] : starts[n + 1]] if v != query["query_id"]]
                    out += [(query["query_id"], v, d) for d, v in sorted(mine)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = met.mapInPandas(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Indexes all rows (vec_id, embedding) and searches for queries of the same columns."""
    scratch = Scratch(rows.sparkSession, "hnsw")
    shards = scratch.save(index(valid_vectors(rows), k), "index")
    asked = valid_vectors(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x"))
    return search(shards, asked, k)


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
