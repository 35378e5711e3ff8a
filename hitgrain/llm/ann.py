"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample of ``FIT`` vectors by spherical k-means, ``BRANCH`` ways at each node. Every
vector goes down to one leaf. A search keeps open nodes in a priority queue and takes the nearest first, until it has
visited a number of leaves. That number is calibrated: for a bounded set of ``PROBES`` queries the true neighbours are
found among all vectors, and leaf visits are widened until ``RECALL`` of them lie in visited leaves.

Scale: the tree is bounded by the sample and is all that is handed to every task. Neighbouring leaves share a slab of about
``SLAB_BYTES``; a larger leaf, or one vector with a third of all rows, fills slabs of its own. The queries that visit a slab are cut
into blocks of about ``ASKED``. A task holds one slab and one block, keeps the best few of each query over all leaves it
holds, leaves out leaves whose angle to the query less their radius cannot reach the worst of these, and passes on one short list per query.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another number of components
than most, take no part. Scores are cosines in double precision of the original vectors, scaled by powers of two so
that tiny and huge components neither vanish nor overflow; equal scores rank by smaller identifier, null last. Rows that share the
identifier of a query are one query, by the least of their vectors. A query never finds rows with its own identifier. Rows that
repeat are candidates each. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.session import stage_table

FIT = 20_000
BRANCH = 8
LEAF = 256
PROBES = 200
RECALL = 0.94
SLAB_BYTES = 32 << 20
ASKED = 32_768
# Rows of a slab that are multiplied at once.
STEP = 4096


def usable_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part."""
    vectors = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.filter(sound & F.exists("vector", lambda x: x != 0.0))
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return vectors.filter(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


class Tree:
    """Nodes with their centres; ``children[n]`` are the nodes below n, ``leaf[n]`` its leaf number or -1."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF, seed: int = 3):
        self.children: list[np.ndarray] = [np.array([], int)]
        self.centres = [np.zeros(sample.shape[1])]
        rng = np.random.default_rng(seed)
        open_nodes = [(0, np.unique(unit_rows(sample), axis=0))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if len(rows) <= leaf_rows:
                continue
            centres, owner = _spherical_kmeans(rows, min(branch, len(rows)), rng)
            used = np.unique(owner)
            if len(used) < 2:
                continue
            first = len(self.children)
            self.children[node] = np.arange(first, first + len(used))
            for k, own in enumerate(used):
                self.children.append(np.array([], int))
                self.centres.append(centres[own])
                open_nodes.append((first + k, rows[owner == own]))
        self.matrix = np.array(self.centres)
        self.leaf = np.full(len(self.children), -1)
        leaves = [n for n, below in enumerate(self.children) if not len(below)]
        self.leaf[leaves] = np.arange(len(leaves))
        self.leaves = len(leaves)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf each row goes down to."""
        at, rows = np.zeros(len(rows), int), unit_rows(rows)
        while True:
            inner = [n for n in np.unique(at) if len(self.children[n])]
            if not inner:
                return self.leaf[at]
            for node in inner:
                own = np.flatnonzero(at == node)
                below = self.children[node]
                at[own] = below[(rows[own] @ self.matrix[below].T).argmax(axis=1)]

    def leaf_centres(self) -> np.ndarray:
        return self.matrix[np.flatnonzero(self.leaf >= 0)[np.argsort(self.leaf[self.leaf >= 0])]]

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of best-bin-first search, ``most`` at the most."""
        near = self.matrix @ unit_rows(query[None, :])[0]
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if len(self.children[node]):
                for below in self.children[node].tolist():
                    heapq.heappush(queue, (-near[below], below))
            else:
                found.append(int(self.leaf[node]))
        return found


def _spherical_kmeans(rows: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    owner = np.zeros(len(rows), int)
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres, owner


def matrix_of(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def scaled_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component lies between 1/2 and 1."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True))[1])


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: list, k: int, own=None, barred=None, places=None):
    """(query, vector id, cosine) of the ``k`` nearest rows of each query, other than those with its own id.

    ``own`` gives the identifiers of rows where ``ids`` are something else, ``barred`` what a query may not see, and
    ``places`` the name of each query in the result (its identifier by default).
    """
    numbers = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
    order = np.argsort(numbers, kind="stable")
    own = numbers if own is None else own
    vectors, own, ids = scaled_rows(vectors[order]), own[order], [ids[i] for i in order]
    queries = scaled_rows(queries)
    norms, query_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    rough = (queries / query_norms[:, None]) @ (vectors / norms[:, None]).T
    rough[query_ids[:, None] == own[None, :]] = -np.inf
    if barred is not None:
        rough[barred[:, order]] = -np.inf
    # Rounding may part equal scores here, so all that may belong to the best are measured again.
    bars = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
    names = (query_ids if places is None else places).tolist()
    for q, line in enumerate(rough):
        near = np.flatnonzero((line >= bars[q] - 1e-9) & (line > -np.inf))
        score = (vectors[near] * queries[q]).sum(axis=1) / (norms[near] * query_norms[q])
        for i in np.argsort(-score, kind="stable")[:k].tolist():
            yield names[q], ids[near[i]], float(score[i])


SCORES = "query_id long, vec_id long, score double"


def _score_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"]
    )


def top_of(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_neighbours(indexed: DataFrame, query_ids: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries among all vectors, block by block, with the leaf of each."""
    wanted = np.array(query_ids, dtype=np.int64)

    def search(batches):
        for batch in batches:
            if batch.num_rows:
                leaves, ids = batch["leaf"].to_pylist(), batch["vec_id"].to_pylist()
                # Places stand for rows, so that each row found brings its leaf, also where identifiers repeat.
                order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
                held = matrix_of(batch["vector"])
                own = np.array([np.iinfo(np.int64).max if ids[i] is None else ids[i] for i in order])
                rows = list(best_of(queries, wanted, held[order], list(range(len(order))), k, own))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([ids[order[r[1]]] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([leaves[order[r[1]]] for r in rows], pa.int32()),
                    ],
                    names=["query_id", "vec_id", "score", "leaf"],
                )

    return top_of(indexed.select("vec_id", "vector", "leaf").mapInArrow(search, SCORES + ", leaf int"), k)


INDEX = "leaf int, near double, vec_id long, vector array<double>"


def _in_leaves(tree: Tree):
    centres = tree.leaf_centres()

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                matrix = matrix_of(batch["vector"])
                leaves = tree.leaf_of(matrix)
                near = np.einsum("ij,ij->i", unit_rows(matrix), centres[leaves])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves.astype(np.int32)), pa.array(near), batch["vec_id"], batch["vector"]],
                    names=["leaf", "near", "vec_id", "vector"],
                )

    return assign


class Slabs:
    """Which slabs hold the vectors of a leaf: ``pieces[leaf]`` of them from ``first[leaf]`` on."""

    def __init__(self, tree: Tree, counts: dict[int, tuple[int, float]], rows: int):
        self.first, self.pieces = np.zeros(tree.leaves, int), np.zeros(tree.leaves, int)
        # Cosine of the widest vector of each leaf; the centres need not be of length one.
        self.widest = np.array([counts.get(leaf, (0, 1.0))[1] for leaf in range(tree.leaves)])
        slab, filled = 0, 0
        for leaf in range(tree.leaves):
            held = counts.get(leaf, (0, 1.0))[0]
            if filled and filled + held > rows:
                slab, filled = slab + 1, 0
            self.first[leaf], self.pieces[leaf] = slab, -(-held // rows)
            filled += held
            if filled >= rows:
                slab, filled = slab + max(1, int(self.pieces[leaf])), 0


def _visiting(tree: Tree, slabs: Slabs, most: int):
    """One row for each query and slab, with the leaves to look at there."""

    def visit(batches):
        for batch in batches:
            out: list[tuple] = []
            queries = matrix_of(batch["vector"]) if batch.num_rows else ()
            for at, query in enumerate(queries):
                wanted: dict[int, list[int]] = {}
                for leaf in tree.visits(query, most):
                    for piece in range(slabs.pieces[leaf]):
                        wanted.setdefault(int(slabs.first[leaf]) + piece, []).append(leaf)
                out += [(at, slab, leaves) for slab, leaves in wanted.items()]
            if out:
                places = pa.array([row[0] for row in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row[1] for row in out], pa.int32()),
                        batch["vec_id"].take(places),
                        batch["vector"].take(places),
                        pa.array([row[2] for row in out], pa.list_(pa.int32())),
                    ],
                    names=["slab", "query_id", "asked", "leaves"],
                )

    return visit


def _searched(tree: Tree, slabs: Slabs, k: int):
    centres = tree.leaf_centres()

    def search(asked, held):
        if not asked.num_rows or not held.num_rows:
            return _table_of([])
        queries, query_ids = matrix_of(asked["asked"]), asked["query_id"].to_numpy()
        leaves = held["leaf"].to_numpy()
        order = np.argsort(leaves, kind="stable")
        leaves, held = leaves[order], held.take(pa.array(order))
        here = np.unique(leaves)
        wanted = np.zeros((len(queries), len(here)), dtype=bool)
        lists = asked["leaves"].combine_chunks()
        wanted[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), np.searchsorted(here, lists.flatten().to_numpy())] = True
        lengths = np.maximum(np.sqrt((centres[here] ** 2).sum(axis=1)), 1e-300)
        angle = np.arccos(np.clip((unit_rows(queries) @ centres[here].T) / lengths, -1.0, 1.0))
        # The widest is stored against centres as they are, so both are taken to unit length first.
        reach = np.cos(np.maximum(0.0, angle - np.arccos(np.clip(slabs.widest[here] / lengths, -1.0, 1.0)))) + 1e-9
        best: list[list[tuple[float, bool, int]]] = [[] for _ in range(len(queries))]
        bar = np.full(len(queries), -np.inf)
        vectors, ids = held["vector"].combine_chunks(), held["vec_id"].to_pylist()
        for at in range(0, len(leaves), STEP):
            some = leaves[at : at + STEP]
            own = np.searchsorted(here, some)
            columns = np.unique(own)
            visit = wanted[:, columns] & (reach[:, columns] >= bar[:, None])
            who = np.flatnonzero(visit.any(axis=1))
            if not len(who):
                continue
            barred = ~visit[who][:, np.searchsorted(columns, own)]
            rows = best_of(queries[who], query_ids[who], matrix_of(vectors.slice(at, STEP)), ids[at : at + STEP], k, barred=barred, places=who)
            for q, vec_id, score in rows:
                best[q].append((-score, vec_id is None, vec_id or 0))
            for q in who.tolist():
                if len(best[q]) > k:
                    best[q] = sorted(best[q])[:k]
                if len(best[q]) == k:
                    bar[q] = -max(best[q])[0]
        return _table_of(
            [(int(query_ids[q]), None if null else vec_id, -score) for q, line in enumerate(best) for score, null, vec_id in sorted(line)]
        )

    return search


def _table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_score_rows(rows)])


def calibrated_visits(tree: Tree, indexed: DataFrame, queries: DataFrame, k: int, recall: float, probes: int) -> int:
    """Leaf visits with which ``recall`` of the true neighbours of a bounded set of queries are found."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).collect()
    if not picked:
        return 1
    matrix = np.array([row["vector"] for row in picked])
    ids = [row["vec_id"] for row in picked]
    # At most ``probes * k`` rows.
    places = exact_neighbours(indexed, ids, matrix, k).select("query_id", "leaf").collect()
    at = {i: {leaf: n for n, leaf in enumerate(tree.visits(row, tree.leaves))} for i, row in zip(ids, matrix, strict=True)}
    needed = sorted(at[place["query_id"]][place["leaf"]] + 1 for place in places)
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def nearest_neighbours(
    rows: DataFrame,
    is_query,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    fit: int = FIT,
    recall: float = RECALL,
    probes: int = PROBES,
    slab_bytes: int = SLAB_BYTES,
    asked: int = ASKED,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for every row with ``is_query(vec_id)``."""
    vectors = usable_vectors(rows, vec_id, vector)
    sample = [row["vector"] for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).collect()]
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(np.array(sample))
    # Stored numbers part rows that are the same in everything.
    indexed = stage_table(
        vectors.mapInArrow(_in_leaves(tree), INDEX).withColumn("_n", F.monotonically_increasing_id()), "ann-index"
    )
    queries = indexed.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    most = calibrated_visits(tree, indexed, queries, k, recall, probes)
    # One row per leaf, as many as the sample allows.
    counts = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()
    slabs = Slabs(tree, {r["leaf"]: (r["n"], r["near"]) for r in counts}, max(1, slab_bytes // (8 * max(1, len(sample[0])))))
    visits = queries.mapInArrow(_visiting(tree, slabs, most), "slab int, query_id long, asked array<double>, leaves array<int>")
    visits = stage_table(visits, "ann-visits")
    blocks = visits.groupBy("slab").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("_blocks"))
    asking = visits.join(blocks, "slab").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int"))
    first = F.get(F.array(*map(F.lit, slabs.first.tolist())), F.col("leaf"))
    pieces = F.get(F.array(*map(F.lit, slabs.pieces.tolist())), F.col("leaf"))
    held = indexed.withColumn("slab", (first + F.pmod(F.col("_n"), pieces)).cast("int")).join(blocks, "slab")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    found = (
        asking.select("slab", "block", "query_id", "asked", "leaves")
        .groupBy("slab", "block")
        .cogroup(held.select("slab", "block", "leaf", "vec_id", "vector").groupBy("slab", "block"))
        .applyInArrow(_searched(tree, slabs, k), SCORES)
    )
    return top_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
