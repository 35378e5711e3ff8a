"""Source divergence, sharding and vector codes against plain models."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hitgrain.llm import divergence, sharding, vector_codes
from hitgrain.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, top):
    """{(lang, source, part, item): (value, rank)} of (text, lang, source)."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(brute.LOWER))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = {}
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: n for (g, s), n in groups.items() if g == lang}
        whole = sum(own.values(), Counter())

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p = {s: shares(n) for s, n in own.items()}
        q = shares(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item): (-value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def audited(df, **options):
    return {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in divergence.audit_sources(df, **options).collect()}


@pytest.mark.parametrize("least, many, few, tile", [(1, 1024, 128, 1024), (2, 3, 2, 5)])
def test_audit_of_awkward_rows(odd, odd_rows, least, many, few, tile):
    got = audited(odd, least=least, many=many, few=few, tile=tile)
    assert got == plain_audit([(r[1], r[2], r[3]) for r in odd_rows], least, 10)


def test_audit_of_random_counts(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzÜ一"]
    rows = [
        (" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(60))), rng.choice("pq"), f"s{rng.randrange(7)}")
        for _ in range(120)
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, p int").repartition(5)
    assert audited(df, least=10) == plain_audit(rows, 10, 10)
    assert audited(df, least=10, many=2, few=2, tile=4) == plain_audit(rows, 10, 10)


def test_audit_without_terms(spark, none):
    rows = [("", "x", "a"), (None, "x", "b"), ("12 .", "x", None), ("once", None, "a")]
    got = audited(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert got == plain_audit(rows, 10, 10) and {v for v, _ in got.values()} == {0}
    assert divergence.audit_sources(none).count() == 0


def test_long_texts_are_cut_between_terms(spark):
    text = "abc é-" * 500 + "x" * 1000 + " end"
    df = spark.createDataFrame([(text, "x", "a"), (text, "x", "b")], "text string, lang string, source string")
    got = divergence.count_terms(df, entries=1, piece=7).filter("source = 'a'").collect()
    assert {r["term"]: r["n"] for r in got if r["term"]} == Counter(TERM.findall(text))
    assert all(r["docs"] == 1 for r in got)


def unit(key, name):
    first = 42 if key is None else xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), seed=42).intdigest()
    return ((xxhash.xxh64(name.encode(), seed=first).intdigest() >> 11) + 0.5) / 2.0**53


def plain_shard(key, tree):
    while tree.children:
        tree = min((c for c in tree.children if c.weight > 0), key=lambda c: -math.log(unit(key, c.name)) / c.weight)
    return tree.shard


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_shards_of_awkward_rows(odd, odd_rows, ranges):
    tree = sharding.hash_tree()
    sharded = sharding.sharded_documents(odd, tree, ranges=ranges)
    rows = sharded.collect()
    assert sharded.select("row.*").columns == odd.columns
    assert sorted((str(r["row"]["doc_id"]), r["row"]["text"] or "") for r in rows) == sorted((str(r[0]), r[1] or "") for r in odd_rows)
    slots = defaultdict(list)
    for r in rows:
        assert r["shard"] == plain_shard(r["doc_id"], tree)
        assert r["grown_shard"] == plain_shard(r["doc_id"], sharding.grown(tree))
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 8
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for placed in slots.values():
        placed.sort()
        assert [s for s, _ in placed] == list(range(len(placed)))
        assert [i for _, i in placed] == sorted((i for _, i in placed), key=lambda i: (i is not None, i))
    texts = {r["doc_id"]: r["row"]["text"] or "" for r in rows if r["doc_id"] is not None}
    for r in sharding.shard_digests(sharded).collect():
        if r["doc_id"] is not None:
            assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())


def test_no_rows_no_shards(none):
    assert sharding.shard_digests(sharding.sharded_documents(none, sharding.hash_tree())).count() == 0


def test_rows_move_only_where_weights_change(spark):
    tree = sharding.hash_tree()
    wide = sharding.grown(sharding.grown(tree))
    heavy = sharding.reweighted(tree, {5: 3.0})
    keys = spark.range(-3000, 20_000).select(
        "id", *[sharding.shard_of(F.col("id"), t).alias(n) for n, t in (("a", tree), ("b", sharding.grown(tree)), ("c", wide), ("d", heavy))]
    )
    rows = keys.collect()
    assert {r["b"] for r in rows if r["a"] != r["b"]} == {24}
    assert {r["c"] for r in rows if r["b"] != r["c"]} == {25}
    # The heavier shard lies in the second rack of the first region: the other region only loses rows to that region.
    assert all(r["d"] < 12 for r in rows if r["a"] != r["d"])
    assert all(r["d"] == r["a"] or r["a"] >= 12 or r["d"] // 4 == 1 for r in rows)
    share = Counter(r["a"] for r in rows)
    assert len(share) == 24 and all(abs(n / len(rows) * 24 - 1) < 0.2 for n in share.values())
    grown = Counter(r["d"] for r in rows)
    assert abs(grown[5] / len(rows) - 3 / 26) < 0.02
    assert all(r["a"] == plain_shard(r["id"], tree) for r in rows[::97])


def test_shards_of_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op12_sharding"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    tree = sharding.hash_tree()
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == plain_shard(r["doc_id"], tree)
        assert r["grown_shard"] in (r["shard"], 24)
    own = defaultdict(list)
    for r in got:
        own[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in own.values())


def plain_codes(rows, parts=8, size=16, rounds=6):
    """[(vec_id, code, error, label_error)] and the digest, of sound rows of one length, with plain integers."""
    def whole(x):
        return math.floor(x * 4096) if abs(x) < 2**52 else int(x) * 4096

    def key(row):
        return (row[0] is None, row[0] or 0, row[1])

    width = max(1, -(-len(rows[0][1]) // parts))
    vectors = [[whole(x) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: key(rows[i]))[:size]
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(vectors[i], k) for i in order] for k in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for k, book in enumerate(books):
            own = defaultdict(list)
            for v in vectors:
                own[nearest(cut(v, k), book)[1]].append(cut(v, k))
            books[k] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(book)]
    out, by_label = [], Counter()
    for (vec_id, _, label), v in zip(rows, vectors, strict=True):
        found = [nearest(cut(v, k), books[k]) for k in range(parts)]
        error = sum(e for e, _ in found)
        by_label[label] += error
        out.append((vec_id, "".join(f"{i:02x}" for _, i in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda n: n if n < 2**63 else None
    return sorted(((i, c, fit(e), fit(by_label[n])) for i, c, e, n in out), key=str), digest


def coded(df):
    got = vector_codes.compress_vectors(df).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str), {r["codebooks_sha256"] for r in got}


VECTORS = "vec_id long, embedding array<double>, label int, code string, `row` string, error long"


def test_codes_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(2)
    line = lambda n=11: [rng.choice([-1.0, 0.0, 0.25, 1e-9, -1e-9, rng.gauss(0, 1)]) for _ in range(n)]
    sound = [(i, line(), i % 3) for i in range(60)] + [(7, line(), None), (None, line(), None), (None, line(), 1), (-4, line(), 2)]
    sound += [sound[3]] * 4 + [(100 + i, sound[5][1], 0) for i in range(20)]
    poor = [(1, None, 0), (2, [nan] + line(10), 0), (3, [inf] + line(10), 1), (4, [None] + line(10), 1), (5, line(8), 0), (6, [], 0)]
    df = spark.createDataFrame([(*r, "clash", "x", 1) for r in [*sound, *poor]], VECTORS).repartition(4)
    want, digest = plain_codes(sound)
    assert coded(df) == (want, {digest})
    few, digest = plain_codes(sound[:5])
    assert coded(spark.createDataFrame([(*r, "c", "x", 1) for r in sound[:5]], VECTORS)) == (few, {digest})
    assert vector_codes.compress_vectors(df.limit(0)).count() == 0


def test_codes_of_huge_components(spark):
    rng = random.Random(3)
    size = lambda: rng.choice([1.0, 3e4, 1e9, 1e20])
    rows = [(i, [rng.gauss(0, 1) * size() for _ in range(8)], i % 2) for i in range(40)] + [(99, [1e300] * 8, 1), (98, [-1.7e308] * 8, 0)]
    want, digest = plain_codes(rows)
    df = spark.createDataFrame([(*r, "c", "x", 1) for r in rows], VECTORS).repartition(3)
    assert coded(df) == (want, {digest})


def test_codes_of_query(spark):
    rows = [
        (r["vec_id"], [float(x) for x in r["embedding"]], r["label"])
        for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
        if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])
    ]
    want, digest = plain_codes(rows)
    got = QUERIES["op13_vector_codes"](spark, SMALL).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_gnat_leaves_out_only_what_is_farther():
    rng = np.random.default_rng(4)
    for spread in (3, 40, 5000):
        centres = rng.integers(-spread, spread, (6, 8))
        entries = np.vstack([centres[rng.integers(0, 6, 26)] + rng.integers(-2, 3, (26, 8)), np.repeat(centres[:2], 3, axis=0)]).astype(float)
        rows = np.vstack([entries, centres[rng.integers(0, 6, 300)] + rng.integers(-spread, spread, (300, 8)) // 8]).astype(float)
        tree = vector_codes.Gnat(entries)
        code, gap = tree.nearest(rows)
        full = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == full.argmin(axis=1)).all() and (gap == full.min(axis=1)).all()
        if spread == 5000:
            assert tree.measured < 0.8 * full.size
        exact = vector_codes.Gnat(np.array([[int(x) for x in e] for e in entries.tolist()], dtype=object))
        wide, wide_gap = exact.nearest(rows)
        assert (wide == code).all() and (wide_gap == gap).all()


def test_same_vectors_many_times(spark):
    rows = [(i, [0.5] * 16, 3) for i in range(200)]
    df = spark.createDataFrame([(*r, "c", "x", 1) for r in rows], VECTORS)
    want, digest = plain_codes(rows)
    assert coded(df) == (want, {digest})
    assert df.count() == len(want)
