"""Removal of repeated passages by a distributed sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller identifier, or same document and
earlier start) is removed. Sorting a suffix for every byte of the corpus would move a hundred times the corpus, so
suffixes are taken at anchors: in every window of ``LENGTH`` bytes the ``GRAM`` bytes with the smallest hash. Equal
windows have equal anchors at equal places, so nothing is lost by it. The steps:

1. Texts are stored in blocks of about ``BLOCK_BYTES``, bucketed by block, and later steps read them without a shuffle.
   Equal texts share a block, except those with more than ``HOT_SHARE`` of all rows, which are spread.
2. Each block sends the distinct hashes of its anchors, and hears which of them occur anywhere else.
3. Anchors that do are compared with all that their windows cover. Equal ones are settled by a minimum. If an anchor
   occurs with different surroundings, the first of each kind goes on.
4. Those are sorted by the suffix that begins at the anchor: blocks send sorted front-coded runs, split by ranges of
   anchor hashes, and a loser tree merges the runs of a range. It knows how much neighbours share, so for each window
   the runs of suffixes that share its right part follow without comparing again; its left part is at most
   ``LENGTH - GRAM`` bytes and is compared by hash.
   An anchor with more than ``HOT_KINDS`` kinds of surroundings would fill a range by itself. Its windows are hashed
   one by one instead, and the earliest of equal ones is a minimum per window, taken in blocks first.
5. Intervals of repeated windows are brought back to their block, joined, and removed.

Scale: the shuffles move texts once and then hashes, about one in 25 bytes has one, and surroundings of the few anchors
at the edges of repeated passages. Minima combine before their shuffle. Number of blocks and ranges follow the bytes.

Defined results: a null text is empty. Null identifiers come before all others. Of rows with one identifier, the order
of their text hashes decides; rows that repeat fully count in the order in which they were stored, so one stays. Texts
shorter than ``LENGTH`` bytes stay as they are.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgrain.llm.common import give_back, text_or_empty
from hitgrain.llm.shingles import mixed, prefix_sums, span_hashes
from hitgrain.llm.suffix_runs import front_code, front_decode, merge_runs
from hitgrain.session import stage_table, work_dir

LENGTH = 100
GRAM = 50
# A task takes about ten times this; the programs of one executor share its memory.
BLOCK_BYTES = 8 << 20
# Anchor hashes and suffixes of one range, about.
RANGE_HASHES = 400_000
RANGE_SUFFIXES = 25_000
# An anchor with more kinds of surroundings than this is settled window by window, not in one range.
HOT_KINDS = 1000
HOT_SHARE = 1e-4
HOT_ROWS = 1000
# Buffers are scanned in pieces of so many windows; places within them fit into 24 bits.
SCAN = 1 << 20
PLACE_BITS = 24
NULL_FIRST = -(1 << 63)


def _of_group(step):
    """``step`` for the rows of a group; what it freed goes back to the system, since workers wait between tasks beside others."""

    def run(key, rows):
        try:
            return step(key, rows)
        finally:
            give_back()

    return run


def _of_block(step):
    """The same for the rows of a block and what else belongs to it."""

    def run(key, docs, others):
        try:
            return step(key, docs, others)
        finally:
            give_back()

    return run


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (hash of the anchor, its place, first and last window that it stands for) over all windows of a text."""
    out = [_anchors(text, at, min(at + SCAN, len(text) - length + 1), length, gram) for at in range(0, len(text) - length + 1, SCAN)]
    return [np.concatenate(parts) for parts in zip(*out, strict=True)] if out else [np.array([], np.int64)] * 4


def _anchors(text: bytes, begin: int, end: int, length: int, gram: int):
    buffer = np.frombuffer(text, np.uint8)[begin : end - 1 + length]
    sums = prefix_sums(buffer)
    places = np.arange(len(buffer) - gram + 1)
    grams = span_hashes(sums, places, places + gram)
    keyed = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | places.astype(np.uint64)
    # Minima over ``width`` neighbours, by doubling.
    width, span = length - gram + 1, 1
    lowest = keyed
    while 2 * span <= width:
        lowest = np.minimum(lowest[:-span], lowest[span:])
        span *= 2
    if span < width:
        lowest = np.minimum(lowest[: len(lowest) - (width - span)], lowest[width - span :])
    chosen = (lowest & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    place = chosen[first]
    return grams[place].view(np.int64), place + begin, first + begin, last + begin


def _surroundings(text: bytes, place, first, last, length: int) -> np.ndarray:
    """A hash of all bytes that each anchor's windows cover, and of the anchor's place in them."""
    whole = span_hashes(prefix_sums(np.frombuffer(text, np.uint8)), first, last + length)
    return mixed(whole + ((place - first) * 1000 + (last - first)).astype(np.uint64)).view(np.int64)


def _merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that meet."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > ends[:-1]])
    return begins[new], ends[np.concatenate([new[1:], [True]])]


def stored_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``ref``, ``doc``, ``tie``, ``block``, ``doc_id`` and ``text`` of every row, bucketed by ``block``."""
    spark = docs.sparkSession
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("doc", F.coalesce("doc_id", F.lit(NULL_FIRST)))
    seen = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(1, -(-(seen["bytes"] or 0) // block_bytes))
    limit = max(HOT_ROWS, int(seen["rows"] * HOT_SHARE))
    # At most 1 / HOT_SHARE texts.
    hot = rows.groupBy("tie").count().filter(F.col("count") > limit).select("tie", F.lit(True).alias("_hot"))
    salted = F.when(F.col("_hot"), F.xxhash64("tie", "doc_id")).otherwise(F.col("tie"))
    rows = rows.join(F.broadcast(hot), "tie", "left").withColumn("block", F.pmod(salted, F.lit(blocks)).cast("int"))
    path = work_dir(spark, "blocks")
    name = "blocks_" + path.rpartition("-")[2]
    (
        rows.repartition(blocks, "block")
        .select(F.monotonically_increasing_id().alias("ref"), "doc", "tie", "block", "doc_id", "text")
        .write.option("path", path)
        .option("compression", "zstd")
        .bucketBy(blocks, "block")
        .saveAsTable(name)
    )
    return spark.table(name)


HASHES = "shard int, block int, hashes binary, twice binary"


def _sent_hashes(shards: int, length: int):
    def send(key, group):
        found = []
        for text in group["text"]:
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            found.append(anchors(raw, length)[0])
        hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.array([], np.int64),) * 2
        shard = (hashes.view(np.uint64) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        hashes, counts, shard = hashes[order], counts[order], shard[order]
        present, starts = np.unique(shard, return_index=True)
        stops = np.append(starts, len(shard))[1:]
        return pa.table(
            {
                "shard": pa.array(present.astype(np.int32)),
                "block": pa.array([key[0].as_py()] * len(present), pa.int32()),
                "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
                "twice": pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()),
            }
        )

    return send


def _repeated(key, group):
    """Of the hashes that each block sent, those that occur more than once in all blocks."""
    parts = [np.frombuffer(raw, np.int64) for raw in group["hashes"].to_pylist()]
    joined = np.concatenate(parts)
    twice = [np.unpackbits(np.frombuffer(raw, np.uint8))[: len(p)] for raw, p in zip(group["twice"].to_pylist(), parts, strict=True)]
    unique, place, counts = np.unique(joined, return_inverse=True, return_counts=True)
    often = counts > 1
    often[place[np.concatenate(twice) == 1]] = True
    keep = often[place]
    ends = np.cumsum([0, *map(len, parts)])
    heard = [part[keep[a:b]].tobytes() for part, a, b in zip(parts, ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": group["block"], "heard": pa.array(heard, pa.binary())})


CANDIDATES = "block int, ref long, doc long, tie long, hash long, around long, place int, first int, last int, settled boolean"
_CANDIDATE_KINDS = {"block": pa.int32(), "place": pa.int32(), "first": pa.int32(), "last": pa.int32(), "settled": pa.bool_()}


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc", "ascending"), ("tie", "ascending"), ("ref", "ascending")])


def _candidates(length: int):
    names = [part.split()[0] for part in CANDIDATES.split(", ")]

    def find(key, docs, heard):
        known = np.unique(np.concatenate([np.frombuffer(raw, np.int64) for raw in heard["heard"].to_pylist()] or [np.array([], np.int64)]))
        columns: dict[str, list] = {name: [] for name in names}
        docs = _ordered(docs.select(["ref", "doc", "tie", "text"]))
        for ref, doc, tie, text in zip(*(docs[name] for name in ("ref", "doc", "tie", "text")), strict=True):
            raw = text.as_buffer().to_pybytes()
            if len(raw) < length or not len(known):
                continue
            hashes, place, first, last = anchors(raw, length)
            own = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
            if not own.any():
                continue
            hashes, place, first, last = hashes[own], place[own], first[own], last[own]
            values = (ref.as_py(), doc.as_py(), tie.as_py())
            for name, value in zip(("ref", "doc", "tie"), values, strict=True):
                columns[name].append(np.full(len(place), value, np.int64))
            around = _surroundings(raw, place, first, last, length)
            for name, value in (("hash", hashes), ("around", around), ("place", place), ("first", first), ("last", last)):
                columns[name].append(value)
        if not columns["ref"]:
            return pa.table({name: pa.array([], _CANDIDATE_KINDS.get(name, pa.int64())) for name in names})
        arrays = {name: np.concatenate(columns[name]) for name in names if columns[name]}
        # Rows stand in the order of documents and places, so the first of equal surroundings is the earliest here.
        _, earliest = np.unique(np.stack([arrays["hash"], arrays["around"]], axis=1), axis=0, return_index=True)
        settled = np.ones(len(arrays["ref"]), bool)
        settled[earliest] = False
        arrays |= {"settled": settled, "block": np.full(len(settled), key[0].as_py())}
        return pa.table({name: pa.array(arrays[name], _CANDIDATE_KINDS.get(name, pa.int64())) for name in names})

    return find


RUNS = "shard int, run binary"


def _sent_runs(shards: int, length: int):
    """Sorted front-coded runs of a block, one per range of anchor hashes."""
    import pickle
    import zlib

    def send(key, docs, wanted):
        texts = {ref.as_py(): text for ref, text in zip(docs["ref"], docs["text"], strict=True)}
        parts: dict[int, list] = {}
        names = ("ref", "doc", "tie", "hash", "place", "first", "last")
        raws: dict[int, bytes] = {}
        for ref, doc, tie, hash_, place, first, last in zip(*(wanted[name].to_pylist() for name in names), strict=True):
            if ref not in raws:
                raws = {ref: texts[ref].as_buffer().to_pybytes()}
            raw = raws[ref]
            item = (raw[place : last + length], raw[first:place], hash_, (doc, tie, ref, place), first, last)
            parts.setdefault((hash_ % (1 << 64)) % shards, []).append(item)
        rows = []
        for shard, items in parts.items():
            items.sort(key=lambda item: item[0])
            suffixes, *rest = zip(*items, strict=True)
            rows.append((shard, zlib.compress(pickle.dumps((front_code(list(suffixes)), *rest)), 1)))
        shard, run = zip(*rows, strict=True) if rows else ((), ())
        return pa.table({"shard": pa.array(shard, pa.int32()), "run": pa.array(run, pa.binary())})

    return send


WINDOWS = "block int, window long, doc long, tie long, ref long, begin int, end int, settled boolean"


def _sent_windows(length: int):
    """Windows of hot anchors: the first of equal ones of a block, and intervals of all others of the block, settled."""
    names = [part.split()[0] for part in WINDOWS.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def send(key, docs, wanted):
        wanted = wanted.sort_by([(name, "ascending") for name in ("doc", "tie", "ref", "place")])
        refs, first, last = (np.asarray(wanted[name]).astype(np.int64) for name in ("ref", "first", "last"))
        docs_, ties = (np.asarray(wanted[name]).astype(np.int64) for name in ("doc", "tie"))
        texts = dict(zip(docs["ref"].to_pylist(), docs["text"], strict=True)) if len(refs) else {}
        hashes, owners, begins = [], [], []
        starts = np.flatnonzero(np.concatenate([[True], refs[1:] != refs[:-1]])) if len(refs) else []
        for a, b in zip(starts, [*starts[1:], len(refs)], strict=True) if len(refs) else ():
            counts = last[a:b] - first[a:b] + 1
            begin = np.repeat(first[a:b] - counts.cumsum() + counts, counts) + np.arange(counts.sum())
            sums = prefix_sums(np.frombuffer(texts[int(refs[a])].as_buffer().to_pybytes(), np.uint8))
            hashes.append(span_hashes(sums, begin, begin + length).view(np.int64))
            owners.append(np.full(len(begin), a))
            begins.append(begin)
        if not hashes:
            return pa.table({name: pa.array([], kind) for name, kind in zip(names, kinds, strict=True)})
        window, owner, begin = map(np.concatenate, (hashes, owners, begins))
        # Windows stand in the order of documents and places, so the first of equal ones is the earliest here.
        _, earliest = np.unique(window, return_index=True)
        late = np.ones(len(window), bool)
        late[earliest] = False
        # Late windows that follow each other are one interval.
        at = np.flatnonzero(late)
        new = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (begin[at[1:]] != begin[at[:-1]] + 1)])[: len(at)]
        heads, tails = at[new], at[np.concatenate([new[1:], [True]])[: len(at)]]
        rows = np.concatenate([earliest, heads])
        ends = np.concatenate([begin[earliest], begin[tails]]) + length
        settled = np.arange(len(rows)) >= len(earliest)
        own = owner[rows]
        values = (np.full(len(rows), key[0].as_py()), window[rows], docs_[own], ties[own], refs[own], begin[rows], ends, settled)
        return pa.table({name: pa.array(value, kind) for name, value, kind in zip(names, values, kinds, strict=True)})

    return send


def _hot_intervals(blocks: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Intervals of the windows of hot anchors that occur earlier."""
    windows = blocks.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(_of_block(_sent_windows(length)), WINDOWS)
    windows = stage_table(windows, "hot-windows")
    order = F.struct("doc", "tie", "ref", "begin")
    # One row per block and window at most, and minima combine before the shuffle.
    firsts = windows.filter("not settled").groupBy("window").agg(F.min(order).alias("_earliest"))
    late = windows.filter("not settled").join(firsts, "window").filter(order != F.col("_earliest"))
    return windows.filter("settled").select("block", "ref", "begin", "end").unionByName(late.select("block", "ref", "begin", "end"))


INTERVALS = "block int, ref long, begin int, end int"


def _merge_range(length: int, gram: int):
    import pickle
    import zlib

    def merge(key, group):
        packed = [pickle.loads(zlib.decompress(raw)) for raw in group["run"].to_pylist()]
        items, shared, rights = [], [], []
        places = [0] * len(packed)
        for run, same, suffix in merge_runs([front_decode(*part[0]) for part in packed]):
            at = places[run]
            places[run] += 1
            items.append(tuple(column[at] for column in packed[run][1:]))
            shared.append(same)
            rights.append(len(suffix))
        lefts, _, orders, firsts, lasts = zip(*items, strict=True)
        same, right = np.array(shared), np.array(rights)
        first, last = np.array(firsts), np.array(lasts)
        place = np.array([order[3] for order in orders])
        rank = np.empty(len(items), np.int64)
        rank[sorted(range(len(items)), key=orders.__getitem__)] = np.arange(len(items))
        # Hashes of the last ``back`` bytes before the anchor.
        most = length - gram
        left = np.zeros((len(items), most), np.uint8)
        for row, text in enumerate(lefts):
            if text:
                left[row, most - len(text) :] = np.frombuffer(text, np.uint8)
        lines = np.concatenate([left.ravel(), [0]]).astype(np.uint8)
        sums, ends = prefix_sums(lines), (np.arange(len(items)) + 1) * most
        refs, begins = [], []
        for back in range(most + 1):
            own = np.flatnonzero((place - last <= back) & (back <= place - first) & (right >= length - back))
            if len(own) < 2:
                continue
            # Neighbours that share the right part of this window form a run.
            run = np.cumsum(same < length - back)[own]
            before = span_hashes(sums, ends[own] - back, ends[own])
            order = np.lexsort((rank[own], before, run))
            sorted_run, sorted_before = run[order], before[order]
            again = np.concatenate([[False], (sorted_run[1:] == sorted_run[:-1]) & (sorted_before[1:] == sorted_before[:-1])])
            late = own[order[again]]
            refs += [orders[i][2] for i in late.tolist()]
            begins.append(place[late] - back)
        begin = np.concatenate(begins) if begins else np.array([], np.int64)
        return pa.table({"ref": pa.array(refs, pa.int64()), "begin": pa.array(begin.astype(np.int32))})

    return merge


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(docs: pa.Table, intervals: pa.Table):
    """(doc_id, text bytes, begins, ends) of every document of a block."""
    refs = np.asarray(intervals["ref"]).astype(np.int64)
    order = np.argsort(refs, kind="stable")
    refs = refs[order]
    begins, ends = (np.asarray(intervals[name]).astype(np.int64)[order] for name in ("begin", "end"))
    for doc_id, ref, text in zip(docs["doc_id"].to_pylist(), docs["ref"].to_pylist(), docs["text"], strict=True):
        a, b = np.searchsorted(refs, [ref, ref + 1])
        yield doc_id, text.as_buffer().to_pybytes(), *(_merged(begins[a:b], ends[a:b]) if b > a else (begins[:0], ends[:0]))


def _finished(key, docs, intervals):
    rows = []
    for doc_id, raw, begins, ends in _removed(docs, intervals):
        edges = [0, *np.stack([begins, ends], axis=1).ravel().tolist(), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        rows.append((doc_id, len(raw), len(raw) - len(kept), len(begins), kept))
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = LENGTH,
    block_bytes: int = BLOCK_BYTES,
    range_hashes: int = RANGE_HASHES,
    range_suffixes: int = RANGE_SUFFIXES,
    hot_kinds: int = HOT_KINDS,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that remain) of every document.

    ``length`` is at least 2 * GRAM - 50 and at most 250.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], RESULT)
    blocks = stored_blocks(rows, block_bytes)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = max(1, size // (range_hashes * 25))
    sent = blocks.groupBy("block").applyInArrow(_of_group(_sent_hashes(shards, length)), HASHES)
    heard = stage_table(sent.groupBy("shard").applyInArrow(_of_group(_repeated), "block int, heard binary"), "heard")
    candidates = blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(_of_block(_candidates(length)), CANDIDATES)
    candidates = stage_table(candidates, "candidates")
    # The first anchor with equal surroundings settles the others; minima combine before the shuffle.
    order = F.struct("doc", "tie", "ref", "place")
    kinds = candidates.filter("not settled").groupBy("hash", "around").agg(F.min(order).alias("earliest"))
    kinds = stage_table(kinds, "kinds")
    later = (
        candidates.filter("not settled")
        .join(kinds, ["hash", "around"])
        .withColumn("settled", order != F.col("earliest"))
        .select(*candidates.columns)
    )
    later = stage_table(later, "later")
    several = kinds.groupBy("hash").count().filter("count > 1").select("hash", (F.col("count") > hot_kinds).alias("hot"))
    edges = stage_table(later.filter("not settled").join(several, "hash"), "edges")
    hot, edges = edges.filter("hot").drop("hot"), edges.filter("not hot").drop("hot")
    ranges = max(1, edges.count() // range_suffixes)
    runs = blocks.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_of_block(_sent_runs(ranges, length)), RUNS)
    windows = runs.groupBy("shard").applyInArrow(_of_group(_merge_range(length, GRAM)), "ref long, begin int")
    homes = edges.select("ref", "block").distinct()
    found = windows.join(homes, "ref").select("block", "ref", "begin", (F.col("begin") + length).alias("end"))
    if not hot.isEmpty():
        found = found.unionByName(_hot_intervals(blocks, hot, length))
    whole = candidates.filter("settled").unionByName(later.filter("settled"))
    whole = whole.select("block", "ref", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    intervals = stage_table(found.unionByName(whole), "intervals")
    return blocks.groupBy("block").cogroup(intervals.groupBy("block")).applyInArrow(_of_block(_finished), RESULT)


def repeat_digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


