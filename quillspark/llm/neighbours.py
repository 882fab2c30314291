"""Problem 4: the k most similar vectors of every vector.

Method: a forest of random-projection trees. The hyperplanes are fitted on a bounded sample, every vector is
indexed in its leaf of each tree. A query walks down from the roots; the side it leaves behind at each node goes, with
the smallest margin on the way there, into one queue that all trees share, and the next walk begins at the queue's best.
All vectors in the leaves reached are ranked exactly.

Vectors of one direction, whatever their length, are searched once. Only the k + 1 smallest ids of such a group can be
among anyone's k nearest, so that a group may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import cut_lineage, spread

DIMENSIONS, NEIGHBOURS = 64, 5
#: Rows the hyperplanes are fitted on at most, trees, rows aimed at in a leaf, leaves searched for each query.
SAMPLE_ROWS, TREES, LEAF_ROWS, PROBES, LEAST_SAMPLE = 131_072, 6, 512, 18, 4
#: Rows beyond k that are ranked exactly after a leaf's cosines are worked out in short numbers.
SPARE = 8
#: Decimals to which the coordinates of two unit vectors agree that count as one direction.
SAME = 6
#: Rows of a leaf that are compared at once, and how many times as many ask them.
BLOCK_ROWS, ASKING = 4_096, 4


def usable_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows with a vector of the right length, of finite numbers that aren't all zero."""
    numbers = F.col("embeddings")
    limit = F.lit(float("inf"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vectors.select("vec_id", "embeddings").where(F.col("vec_id").isNotNull() & (F.size(numbers) == dimensions) & finite & F.exists(numbers, lambda x: x != 0))


class Forest:
    """Hyperplanes of complete binary trees; the leaves of all trees are numbered through."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.trees, self.depth, self.leaves = trees, depth, 1 << depth
        self.planes = np.zeros((trees, self.leaves - 1, sample.shape[1]), dtype=np.float32)
        self.offsets = np.zeros((trees, self.leaves - 1), dtype=np.float32)
        for tree in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(self.leaves - 1):
                own = rows.pop(node)
                pair = sample[random.choice(own, 2, replace=len(own) < 2)]
                plane = pair[0] - pair[1]
                if not np.any(plane):
                    plane = random.standard_normal(sample.shape[1])
                plane = plane / np.linalg.norm(plane)
                along = sample[own] @ plane
                offset = np.median(along)
                self.planes[tree, node], self.offsets[tree, node] = plane, offset
                left, right = own[along < offset], own[along >= offset]
                rows[2 * node + 1], rows[2 * node + 2] = (left if len(left) else own), (right if len(right) else own)

    def leaves_of(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The leaves that each row searches, best first; the first of them, one a tree, hold the row itself."""
        probes = min(max(probes, self.trees), self.trees * self.leaves)
        rows, inner = np.arange(len(unit)), self.leaves - 1
        planes, offsets = self.planes.reshape(-1, unit.shape[1]), self.offsets.ravel()
        queue = np.full((len(unit), self.trees + probes * self.depth), -np.inf, dtype=np.float32)
        nodes = np.zeros(queue.shape, dtype=np.int32)  # tree * (2 * leaves - 1) + node
        queue[:, : self.trees] = np.inf
        nodes[:, : self.trees] = np.arange(self.trees) * (2 * self.leaves - 1)
        end = self.trees
        taken = np.empty((len(unit), probes), dtype=np.int32)
        for probe in range(probes):
            best = queue.argmax(axis=1) if probe >= self.trees else np.full(len(unit), probe)
            way = queue[rows, best]
            tree, node = np.divmod(nodes[rows, best], 2 * self.leaves - 1)
            queue[rows, best] = -np.inf
            active = np.flatnonzero(node < inner)
            while active.size:
                at, t = node[active], tree[active]
                margin = np.einsum("ij,ij->i", unit[active], planes[t * inner + at]) - offsets[t * inner + at]
                right = margin >= 0
                queue[active, end] = np.minimum(way[active], -np.abs(margin))
                nodes[active, end] = t * (2 * self.leaves - 1) + 2 * at + np.where(right, 1, 2)
                node[active] = 2 * at + np.where(right, 2, 1)
                end += 1
                active = active[node[active] < inner]
            taken[:, probe] = tree * self.leaves + node - inner
        return taken


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), dtype=np.float32) for c in parts]).reshape(-1, dimensions)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps very large and very small numbers in range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _fit(vectors: DataFrame, rows: int, dimensions: int, sample_rows: int, trees: int, leaf_rows: int) -> Forest:
    share = int(min(1.0, 1.5 * sample_rows / rows) * 1_000_003) + 1  # so that no task sorts more than the sample needs
    hashed = vectors.select("embeddings", F.xxhash64("vec_id").alias("draw"), "vec_id").where(F.pmod("draw", F.lit(1_000_003)) < share)
    drawn = hashed.orderBy("draw", "vec_id").limit(sample_rows).select("embeddings").toArrow()
    sample = _unit(_matrix(drawn["embeddings"], dimensions))
    depth = int(np.ceil(np.log2(max(1, rows / leaf_rows))))
    return Forest(sample, trees, max(0, min(depth, int(np.log2(max(1, len(sample) / LEAST_SAMPLE))))))


def _placed(vectors: DataFrame, shared, total: int, dimensions: int, probes: int, block_rows: int) -> DataFrame:
    """leaf, block, part, role (0 stored, 1 asks, 2 both), vec_id and vector of what is compared together.

    The rows of every leaf are counted; a full one is cut into blocks of stored rows and parts of asking rows, each of
    which meets each, by its own count.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                rows = _matrix(batch.column("embeddings"), dimensions)
                leaf = shared.value.leaves_of(_unit(rows).astype(np.float32), probes)
                offsets = pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * leaf.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(leaf.ravel()))], names=["vec_id", "vector", "leaves"])

    trees = shared.value.trees
    routed = spread(vectors.select("vec_id", "embeddings"), "vec_id").mapInArrow(route, "vec_id long, vector binary, leaves array<int>")
    if total > block_rows:
        routed = cut_lineage(routed)
        loads = routed.select(F.posexplode("leaves").alias("probe", "leaf")).groupBy("leaf").agg(F.sum((F.col("probe") < trees).cast("long")).alias("stored"), F.count(F.lit(1)).alias("asking"))
        loads = loads.select("leaf", F.greatest(F.lit(1), F.ceil(F.col("stored") / block_rows)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asking") / (ASKING * block_rows))).cast("int").alias("parts"))
        loads = loads.where("blocks > 1 or parts > 1")  # of all leaves, whose number is bounded by the sample
    each = routed.select("vec_id", "vector", F.posexplode("leaves").alias("probe", "leaf")).withColumn("home", F.col("probe") < trees)
    if total <= block_rows:
        return each.select("leaf", F.lit(0).alias("block"), F.lit(0).alias("part"), F.when(F.col("home"), 2).otherwise(1).alias("role"), "vec_id", "vector")
    each = each.join(F.broadcast(loads), "leaf", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "parts": F.coalesce("parts", F.lit(1))})
    salt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    place = lambda block, part, role: F.struct(block.alias("block"), part.alias("part"), role.alias("role"))
    zero, every = F.lit(0), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    whole = F.array(place(zero, zero, F.when(F.col("home"), 2).otherwise(1)))
    asks = F.transform(every("blocks"), lambda b: place(b, salt("parts", 1), F.lit(1)))
    stored = F.transform(every("parts"), lambda p: place(salt("blocks", 2), p, zero))
    places = F.when((F.col("blocks") == 1) & (F.col("parts") == 1), whole).when(F.col("home"), F.concat(asks, stored)).otherwise(asks)
    return each.withColumn("x", F.explode(places)).select("leaf", "x.block", "x.part", "x.role", "vec_id", "vector")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, dimensions: int = DIMENSIONS, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, leaf_rows: int = LEAF_ROWS, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id and its near (an array of cosine and id, best first) among different usable vectors."""
    total = vectors.count()
    if total == 0:
        return vectors.select("vec_id", F.array().cast("array<struct<cosine:double,id:bigint>>").alias("near"))
    forest = _fit(vectors, total, dimensions, sample_rows, trees, leaf_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # its size is bounded by sample_rows and trees

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        kinds = np.asarray(group["role"])
        ids = np.asarray(group["vec_id"])
        rows = _unit(np.frombuffer(b"".join(group["vector"].to_pylist()), dtype=np.float32).reshape(-1, dimensions))
        stored, asking = np.flatnonzero(kinds != 1), np.flatnonzero(kinds != 0)
        stored = stored[np.argsort(ids[stored], kind="stable")]
        short, names = rows.astype(np.float32), ids[stored]
        lists, sizes, cosines = [], [], []
        few = min(k + SPARE, len(stored))
        for start in range(0, len(asking) if len(stored) else 0, 1024):
            own = asking[start : start + 1024]
            near = short[own] @ short[stored].T
            place = np.minimum(np.searchsorted(names, ids[own]), len(names) - 1)
            here = np.flatnonzero(names[place] == ids[own])
            near[here, place[here]] = -np.inf
            best = np.argpartition(near, len(stored) - few, axis=1)[:, len(stored) - few :]
            best.sort(axis=1)  # ties fall to the smaller id
            value = np.round(np.einsum("ij,ikj->ik", rows[own], rows[stored[best]]), 12)
            value[np.take_along_axis(near, best, axis=1) == -np.inf] = -np.inf
            order = np.argsort(-value, axis=1, kind="stable")[:, :k]
            best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
            real = value > -np.inf
            lists.append(names[best][real])
            cosines.append(value[real])
            sizes.append(real.sum(axis=1))
        sizes = np.concatenate(sizes) if sizes else np.zeros(len(asking), dtype=np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(-np.concatenate(cosines) if cosines else np.empty(0)), pa.array(np.concatenate(lists) if lists else np.empty(0, dtype=np.int64))], names=["far", "id"])
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.table({"vec_id": pa.array(ids[asking]), "near": pa.ListArray.from_arrays(offsets, pairs)})

    placed = _placed(vectors, shared, total, dimensions, probes, block_rows)
    found = placed.select("leaf", "block", "part", "role", "vec_id", "vector").groupBy("leaf", "block", "part").applyInArrow(compare, "vec_id long, near array<struct<far:double,id:bigint>>")
    # Each leaf gives at most k. A vector met in several leaves counts once; its cosine, rounded, has two neighbouring values at most.
    merged = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, 2 * k).alias("near"))
    none = F.array().cast("array<struct<cosine:double,id:bigint>>")
    first = F.reduce("near", none, lambda got, x: F.when((F.size(got) >= k) | F.exists(got, lambda y: y["id"] == x["id"]), got).otherwise(F.concat(got, F.array(F.struct((-x["far"]).alias("cosine"), x["id"].alias("id"))))))
    return merged.select("vec_id", first.alias("near"))


def similar(vectors: DataFrame, k: int = NEIGHBOURS, dimensions: int = DIMENSIONS, **options) -> DataFrame:
    """vec_id, id and cosine of the k nearest usable vectors of every usable vector, itself left out.

    Needs a unique vec_id and embeddings. Null, wrong, zero and unfinished vectors have no row and are nobody's
    neighbour; vectors of one direction are neighbours with cosine 1; ties go to the smaller id. Fewer than k other
    usable vectors give fewer rows.
    """
    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.round(_unit(_matrix(batch.column("embeddings"), dimensions)), SAME) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embeddings"), pa.array([r.tobytes() for r in unit], pa.binary())], names=["vec_id", "embeddings", "unit"])

    rows = usable_vectors(vectors, dimensions).mapInArrow(directions, "vec_id long, embeddings array<float>, unit binary")
    rows = rows.select("vec_id", "embeddings", F.xxhash64("unit").alias("k1"), F.hash("unit").alias("k2"))
    copies = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")).where("n > 1")
    named = rows.join(copies, ["k1", "k2"], "left").select("vec_id", "embeddings", F.coalesce("first", "vec_id").alias("first"), F.coalesce("n", F.lit(1)).alias("n"))
    named = cut_lineage(named)
    by_id = Window.partitionBy("first").orderBy("vec_id")
    members = named.where("n > 1").select("first", "vec_id").withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).select("first", F.col("vec_id").alias("id"))
    asks = named.select("vec_id", "first", "n")
    among = asks.where("n > 1").join(members, "first").where(F.col("vec_id") != F.col("id")).select("vec_id", "id", F.lit(1.0).alias("cosine"))
    near = nearest(named.where(F.col("vec_id") == F.col("first")).select("vec_id", "embeddings"), k, dimensions, **options)
    outside = near.select(F.col("vec_id").alias("first"), F.explode("near").alias("x")).select("first", F.col("x.id").alias("other"), F.col("x.cosine").alias("cosine"))
    singles = outside.join(members.withColumnRenamed("first", "other"), "other", "left").select("first", F.coalesce("id", "other").alias("id"), "cosine")
    beyond = asks.where(F.col("n") <= k).join(singles, "first").select("vec_id", "id", "cosine")
    ranked = among.unionByName(beyond).withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "id")))
    return ranked.where(F.col("place") <= k).select("vec_id", "id", "cosine")


def p4_neighbours(spark, folder: str) -> DataFrame:
    return similar(spark.read.parquet(f"{folder}/previous_index.parquet"))


def p4_found(spark, folder: str) -> DataFrame:
    pairs = p4_neighbours(spark, folder)
    return pairs.select(F.least("vec_id", "id").alias("vec_id_a"), F.greatest("vec_id", "id").alias("vec_id_b")).distinct()
