"""Near-duplicate vectors: small-world graphs per shard, every shard asked for every vector, links verified, components.

Vectors are dealt into shards of about ``SHARD`` rows by a hash of their place. Each shard gets a graph (``hnsw.py``) whose
nodes are leaders: a vector within half of the link angle of a leader is its member, so members of one leader are linked
with each other without fail. Every shard's vectors are then looked up in the graph of every shard. A vector can only be linked
with members of a leader within one and a half link angles; beams are widened until they reach beyond that. Of such
a leader's members, sorted by their angle to it, the triangle inequality settles nearly all; the rest are verified by
their cosine in double precision. In every unit (one shard's vectors against one graph) ``AUDITED`` vectors are also compared
with the whole shard by brute force; as long as the beams found less than ``AUDIT_RECALL`` of their links, the
beams are doubled, and beams as wide as the graph give way to brute force.

A unit returns a count per vector and one link per vector and leader that it has links with, never a row per pair, so a
group of copies costs rows in proportion to its size. Components come from star contraction.

Every vector visits every shard, so the work grows with rows times shards, as the method has it; ``shard`` should be
as large as an executor's memory allows.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id link
with nothing; vectors of different lengths do not link; a row without an id has no component and is not kept; rows with the
same id are one node, but each of them counts as a vector; repeated vectors link like any others; an empty table gives
no rows; other columns pass through in ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import with_row
from lodestar.llm.components import components
from lodestar.llm.hnsw import Graph, width
from lodestar.session import written

#: Rows of a shard.
SHARD = 32_768

#: First width of the beams; vectors of a unit compared by brute force, and the share of links that must be found.
BEAM, AUDITED, AUDIT_RECALL = 24, 256, 0.99

#: Tasks that share the units, if there are so many.
MOST_TASKS = 20_000

#: Angles are taken to be this inexact.
INEXACT = 1e-6

#: Cosines verified at once.
STEP = 1 << 16

GRAPHS_DDL = "size int, shard int, at binary, id binary, vectors binary, links array<binary>, leader binary, rows binary"
GRAPHS = pa.schema([("size", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("at", "id", "vectors")), ("links", pa.list_(pa.binary())), ("leader", pa.binary()), ("rows", pa.binary())])
LINKS_DDL = "at long, n long, u long, v long"
LINKS = pa.schema([(c, pa.int64()) for c in ("at", "n", "u", "v")])


def usable(embedding: Column) -> Column:
    """The vector has a direction."""
    finite = F.forall(embedding, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda e: e != 0), F.lit(False))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Limits:
    """What a least cosine of links means for leaders: members of one are within ``ball``, links reach no leader beyond ``reach``."""

    cosine: float

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)

    @property
    def ball(self) -> float:
        return math.cos(self.angle / 2 - 2 * INEXACT)

    @property
    def reach(self) -> float:
        return math.cos(min(math.pi, 1.5 * self.angle)) - 1e-5


class Shard:
    """A shard's vectors, its graph, and its members by leader and angle."""

    def __init__(self, unit: np.ndarray, graph: Graph):
        self.unit, self.graph = unit, graph
        self.leaders = unit[graph.rows]
        cosine = np.einsum("nd,nd->n", unit, self.leaders[graph.leader])
        angle = np.arccos(np.clip(cosine, -1, 1))
        key = graph.leader * 4.0 + angle
        self.members = np.argsort(key, kind="stable")
        self.key = key[self.members]
        self.ends = np.cumsum(np.bincount(graph.leader, minlength=graph.size))

    def near_leaders(self, unit: np.ndarray, beam: int | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and leader within reach, as far as beams find them; all of them without a beam."""
        flat, leaders = unit.astype(np.float32), self.graph.vectors
        if beam is None:
            found = [np.nonzero(flat[a : a + 512] @ leaders.T >= reach) for a in range(0, len(flat), 512)]
            return np.concatenate([a * 512 + f[0] for a, f in enumerate(found)]), np.concatenate([f[1] for f in found])
        left, queries, nodes = np.arange(len(flat)), [], []
        while len(left):
            ids, sims = self.graph.search(flat[left], beam)
            full = (sims[:, -1] >= reach) & (beam < self.graph.size)
            row, column = np.nonzero((sims >= reach) & ~full[:, None])
            queries.append(left[row])
            nodes.append(ids[row, column])
            left, beam = left[full], 2 * beam
        return np.concatenate(queries), np.concatenate(nodes)

    def links(self, unit: np.ndarray, query: np.ndarray, node: np.ndarray, limits: Limits) -> np.ndarray:
        """How many members of the leader each pair's query is linked with."""
        cosine = np.concatenate([np.einsum("nd,nd->n", unit[query[a : a + STEP]], self.leaders[node[a : a + STEP]]) for a in range(0, len(query), STEP)] or [np.empty(0)])
        angle = np.arccos(np.clip(cosine, -1, 1))
        start = self.ends[node] - np.bincount(self.graph.leader, minlength=self.graph.size)[node]
        sure = np.searchsorted(self.key, node * 4.0 + (limits.angle - angle - INEXACT), side="right")
        sure = np.maximum(sure, start)
        first = np.maximum(np.searchsorted(self.key, node * 4.0 + (angle - limits.angle - INEXACT)), sure)
        counts = sure - start
        open_ = np.maximum(self.ends[node] - first, 0)
        # What the angles leave open is verified, a bounded number of pairs at a time.
        ends = np.cumsum(open_)
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, STEP):
            number = np.arange(a, min(total, a + STEP))
            pair = np.searchsorted(ends, number, side="right")
            member = self.members[first[pair] + number - (ends[pair] - open_[pair])]
            linked = np.einsum("nd,nd->n", unit[query[pair]], self.unit[member]) >= limits.cosine
            counts += np.bincount(pair[linked], minlength=len(counts))
        return counts

    def audited(self, unit: np.ndarray, chosen: np.ndarray, limits: Limits) -> int:
        """Links of the chosen queries by brute force."""
        return int(sum(np.count_nonzero(unit[chosen] @ self.unit[a : a + 4096].T >= limits.cosine) for a in range(0, len(self.unit), 4096)))

    def answer(self, unit: np.ndarray, limits: Limits, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, leader and number of links of all pairs with links. ``own``: the queries are the shard's vectors."""
        chosen = np.unique(np.linspace(0, len(unit) - 1, min(AUDITED, len(unit))).astype(int))
        wanted, beam = self.audited(unit, chosen, limits), BEAM
        while True:
            query, node = self.near_leaders(unit, beam, limits.reach)
            if own:  # every vector knows its own leader
                key = np.unique(np.concatenate((query * self.graph.size + node, np.arange(len(unit)) * self.graph.size + self.graph.leader)))
                query, node = np.divmod(key, self.graph.size)
            counts = self.links(unit, query, node, limits)
            found = int(counts[np.isin(query, chosen)].sum())
            if beam is None or found >= AUDIT_RECALL * wanted:
                return query[counts > 0], node[counts > 0], counts[counts > 0]
            beam = 2 * beam if 2 * beam < self.graph.size else None


def _matrix(data: bytes, size: int, dtype: str) -> np.ndarray:
    return np.frombuffer(data, dtype).reshape(-1, size)


def _graph_row(key: tuple, table: pa.Table, dtype: str, limits: Limits) -> pa.Table:
    size, shard = (k.as_py() for k in key)
    table = table.sort_by("at")  # the same graph, in whatever order the rows come
    vectors = np.concatenate([chunk.flatten().to_numpy() for chunk in table.column("vector").chunks]).reshape(-1, size)
    graph = Graph.build(directions(vectors).astype(np.float32), limits.ball)
    longs = {c: table.column(c).to_numpy().astype("<i8").tobytes() for c in ("at", "id")}
    row = {"size": size, "shard": shard, **longs, "vectors": vectors.astype(dtype).tobytes(), "links": [own.astype("<i4").tobytes() for own in graph.links]}
    return pa.Table.from_pylist([row | {"leader": graph.leader.astype("<i4").tobytes(), "rows": np.array(graph.rows, "<i4").tobytes()}], GRAPHS)


def _shard(row: dict, dtype: str) -> Shard:
    unit = directions(_matrix(row["vectors"], row["size"], dtype))
    rows = np.frombuffer(row["rows"], "<i4")
    links = [np.frombuffer(own, "<i4").reshape(-1, width(level)) for level, own in enumerate(row["links"])]
    leader = np.frombuffer(row["leader"], "<i4").astype(np.int64)
    return Shard(unit, Graph(unit[rows].astype(np.float32), links, leader, len(rows), rows.tolist()))


def _answers(batches: Iterator[pa.RecordBatch], dtype: str, limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            shard, own = _shard(row, dtype), row["block"] == row["shard"]
            unit = directions(_matrix(row["block_vectors"], row["size"], dtype))
            query, node, counts = shard.answer(unit, limits, own)
            if own:  # no vector is linked with itself
                counts = counts - (node == shard.graph.leader[query])
                query, node, counts = query[counts > 0], node[counts > 0], counts[counts > 0]
            at, ids = np.frombuffer(row["block_at"], "<i8"), np.frombuffer(row["block_id"], "<i8")
            there = np.frombuffer(row["id"], "<i8")[np.array(shard.graph.rows)][node]
            sums = np.bincount(query, weights=counts, minlength=len(unit)).astype(np.int64)
            some = np.flatnonzero(sums)
            nothing = pa.nulls(len(some), pa.int64())
            yield pa.record_batch([pa.array(at[some]), pa.array(sums[some]), nothing, nothing], schema=LINKS)
            apart = ids[query] != there
            nothing = pa.nulls(int(apart.sum()), pa.int64())
            yield pa.record_batch([nothing, nothing, pa.array(ids[query][apart]), pa.array(there[apart])], schema=LINKS)


def linked(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", keep: list[str] | None = None, shard: int = SHARD) -> DataFrame:
    """``row``, ``n_links`` (other vectors linked directly), ``component`` (the smallest id that links reach, its own
    included) and ``kept`` (it is that id)."""
    single = dict(vectors.dtypes)[embedding] == "array<float>"
    dtype, limits = "<f4" if single else "<f8", Limits(cosine)
    vector = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = with_row(vectors, keep, id=F.col(vec_id).cast("long"), vector=vector)
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "vectors")

    sound = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).select("at", "id", "vector", F.size("vector").alias("size"))
    shards = sound.groupBy("size").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    shards = written(shards, "shards")
    dealt = sound.join(shards, "size").withColumn("shard", F.pmod(F.xxhash64("at"), F.col("shards")).cast("int"))
    dealt = dealt.select("size", "shard", "at", "id", "vector")
    graphs = dealt.groupBy("size", "shard").applyInArrow(lambda key, table: _graph_row(key, table, dtype, limits), GRAPHS_DDL)
    graphs = written(graphs, "graphs")

    units = min(MOST_TASKS, shards.agg(F.sum(F.col("shards").cast("long") * F.col("shards"))).first()[0] or 1)
    blocks = graphs.select("size", F.col("shard").alias("block"), *[F.col(c).alias(f"block_{c}") for c in ("at", "id", "vectors")])
    asked = blocks.join(shards, "size").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    asked = asked.join(graphs, ["size", "shard"]).repartition(units, "size", "block", "shard")
    found = written(asked.mapInArrow(lambda it: _answers(it, dtype, limits), LINKS_DDL), "answers")

    counts = found.filter("at IS NOT NULL").groupBy("at").agg(F.sum("n").alias("n_links"))
    reached = components(found.filter("u IS NOT NULL").select("u", "v")).withColumnRenamed("u", "id")
    joined = rows.select("row", "at", "id").join(counts, "at", "left").join(reached, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )
