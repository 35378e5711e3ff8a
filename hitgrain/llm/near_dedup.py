"""Near-duplicates by circulant MinHash.

Two permutations make all signature coordinates: the first permutes a document's shingles once, the second is applied
to the result shifted by 0, 1, 2, ... around its circle. ``BANDS`` bands of ``ROWS`` coordinates give the buckets.
At a similarity of 0.85 a pair misses all of them with a probability below 1e-5, and only then is it not compared.

Documents with equal shingle sets form a class and go on as one. In every bucket a centre is compared with
all others; the centre is the member that meets most documents over all buckets. Components that follow settle
most buckets. What is left is compared too: pairs of small buckets one by one, large buckets block by block, always
between different components only, since links within one change nothing. All links are confirmed on full sets.

Scale: texts are read twice, the second time only those of classes that share a bucket are hashed. One group of near
copies with a third of all rows is a star with its centre: as many comparisons as members. Joins on hot buckets or
centres are skewed joins that Spark splits; nothing collects a bucket.

Defined results: a null or empty text, or one without words, has no shingles, is its own component and is kept, unless
its identifier is repeated. Null identifiers are larger than all others; a component of nulls has a null
``component_id``. The column ``kept`` says whether a row has its component's identifier; it is true for several rows if
they share it. ``distinct_documents`` keeps one row of each component: the smallest by identifier, hash of the text and
hash of the row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitgrain.llm.common import ROW, give_back, text_or_empty, unwrapped, wrapped
from hitgrain.llm.components import connected_components
from hitgrain.llm.shingles import mixed, shingle_sets
from hitgrain.session import stage_table

WORDS = 3
PERCENT = 85
BANDS = 20
ROWS = 5
# Buckets up to this size are compared pair by pair, larger ones in blocks.
SMALL = 32
BLOCK = 256
TEXTS = 256


def _mix32(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """One row of minima per set; no set may be empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    # The first permutation.
    base = _mix32((joined ^ (joined >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((coordinates, len(sets)), np.uint32)
    for shift in range(coordinates):
        # The second permutation, its circle turned by ``shift``.
        out[shift] = np.minimum.reduceat(_mix32(base + np.uint32(shift), 0x7FEB352D, 0x846CA68B), starts)
    return out.T


def buckets(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per set and band."""
    parts = signatures(sets, bands * rows).reshape(len(sets), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)).copy()
    for k in range(rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total.astype(np.int64)


FEATURES = "doc_id long, text_hash long, n_shingles long, node binary, buckets array<long>"


def _features(words: int, bands: int, rows: int):
    def features(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                sets = shingle_sets(some["text"].to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for i, row in zip(full, buckets([sets[i] for i in full], bands, rows) if full else [], strict=True):
                    keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        some["doc_id"],
                        some["text_hash"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "buckets"],
                )
        give_back()

    return features


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(words: int):
    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                found = shingle_sets(batch["text"].slice(at, TEXTS).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["node", "shingles"],
                )
        give_back()

    return sets


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    """Whether two set sizes alone leave the similarity possible."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _compared(percent: int):
    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                keep = [
                    alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(some["_left"].to_pylist(), some["_right"].to_pylist(), strict=True)
                ]
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return compare


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough."""
    joined = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_right")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_left")), "a")
        .select("a", "b", "_left", "_right")
    )
    return joined.mapInArrow(_compared(percent), "a binary, b binary")


def _in_blocks(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between different components of large buckets.

    Members are cut into blocks by a hash, and every pair of blocks is one row; a task holds two blocks at a time.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = members.join(sizes, "bucket").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    # Block i meets block j in the group (i, j), i <= j.
    partners = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = dealt.select("bucket", "node", "root", "_own", partners.alias("_other")).withColumns(
        {"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}
    )
    held = spread.join(sets, "node").select("bucket", "_i", "_j", "_own", "node", "root", "shingles")

    def compare(key, group):
        own = group["_own"].to_pylist()
        nodes, roots = group["node"].to_pylist(), group["root"].to_pylist()
        sets_ = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        i, j = key[1].as_py(), key[2].as_py()
        parent = {root: root for root in roots}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = []
        for x in range(len(nodes)):
            for y in range(x + 1, len(nodes)):
                if (i != j and own[x] == own[y]) or top(roots[x]) == top(roots[y]):
                    continue
                small, large = sorted((len(sets_[x]), len(sets_[y])))
                if 100 * small >= percent * large and alike(sets_[x], sets_[y], percent):
                    parent[top(roots[x])] = top(roots[y])
                    links.append((nodes[x], nodes[y]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return held.groupBy("bucket", "_i", "_j").applyInArrow(compare, "a binary, b binary")


LABELS = ("doc_id", "text_hash", "n_shingles", "component_id", "kept")


def label_near_copies(docs: DataFrame, *args, **options) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    return _labelled(docs, *args, **options).select(*LABELS)


def _labelled(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    small: int = SMALL,
    block: int = BLOCK,
) -> DataFrame:
    """The columns of ``label_near_copies``, and the ``root`` of every document that has shingles."""
    body = text_or_empty(F.col(f"`{text}`"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    features = stage_table(texts.mapInArrow(_features(words, bands, rows), FEATURES), "near-features")
    nodes = (
        features.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("low"),
            F.min_by("text_hash", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("text_hash"),
            F.first("n_shingles").alias("n"),
            F.first("buckets").alias("buckets"),
        )
    )
    nodes = stage_table(nodes, "near-nodes")
    members = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").count().filter("count > 1")
    members = stage_table(members.join(shared, "bucket"), "near-members")
    popular = members.groupBy("node").agg(F.sum("count").alias("meets"))
    centres = (
        members.join(popular, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("meets", "node", "n")).alias("centre"))
        .select("bucket", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n"))
    )
    others = stage_table(members.join(centres, "bucket").filter("node <> centre"), "near-others")
    stars = (
        others.filter(_near_sizes(F.col("n"), F.col("centre_n"), percent))
        .select(F.col("centre").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select(F.col("low").alias("_low"), F.col("text_hash").alias("_text_hash"))
    sets = (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_low")) & (F.col("text_hash") == F.col("_text_hash")), "left_semi")
        .select("text")
        .mapInArrow(_sets(words), "node binary, shingles binary")
        .dropDuplicates(["node"])
    )
    sets = stage_table(sets, "near-sets")
    links = stage_table(confirmed(stars, sets, percent), "near-links")
    roots = stage_table(connected_components(links), "near-roots")

    # All pairs with a centre are settled; the rest matters where it still joins different components.
    rest = others.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    unsettled = rest.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("_many"))
    rest = rest.select("bucket", "node", "n", "root").join(unsettled.filter("_a <> _b").select("bucket", "_many"), "bucket")
    rest = stage_table(rest, "near-rest")
    few = rest.filter(F.col("_many") <= small)
    second = few.select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "root")])
    pairs = (
        few.join(second, "bucket")
        .filter((F.col("node") < F.col("node_2")) & (F.col("root") != F.col("root_2")) & _near_sizes(F.col("n"), F.col("n_2"), percent))
        .select(F.col("node").alias("a"), F.col("node_2").alias("b"))
        .distinct()
    )
    more = confirmed(pairs, sets, percent).unionByName(
        _in_blocks(rest.filter(F.col("_many") > small), sets, percent, block)
    )
    more = stage_table(more, "near-more")
    roots = connected_components(links.unionByName(more)) if not more.isEmpty() else roots
    labelled = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = stage_table(labelled.join(lowest, "root").select("node", "root", "component_id"), "near-labels")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return features.join(labelled, "node", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "root",
    )


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each component, with the columns of the input; those without shingles stay."""
    labelled = _labelled(docs, text, doc_id, **options)
    rows = labelled.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("many"))
    # Minima combine before their shuffle.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "many")).alias("first")
    firsts = rows.filter("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.text_hash", "first.many")
    bare = rows.filter("root is null").select("doc_id", "text_hash", F.lit(1).alias("many"))
    kept = firsts.unionByName(bare).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "many")
    kept = stage_table(kept, "near-kept")
    own = F.col(ROW)[doc_id].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty(F.col(ROW)[text])) == F.col("_hash"))
    single = wrapped(docs).join(kept.filter("many = 1"), own, "left_semi")
    repeated = kept.filter("many > 1")
    if repeated.isEmpty():
        return unwrapped(single)
    # Rows with one identifier and one text: the smallest by its hash. Maps have no hash.
    hashed = F.xxhash64(*[F.col(ROW)[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    several = wrapped(docs).join(repeated, own).groupBy("_id", "_hash").agg(F.min_by(ROW, hashed).alias(ROW)).select(ROW)
    return unwrapped(single.unionByName(several))
