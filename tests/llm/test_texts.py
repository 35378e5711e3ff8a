"""Exact copies, near copies, repeated passages and quality on awkward documents and against plain models."""

from __future__ import annotations

import hashlib
import os
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitgrain.llm import common, components, exact_dedup, mixing, near_dedup, quality, suffix_dedup, suffix_runs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_exact_copies(odd, odd_rows, hot_rows):
    got = exact_dedup.label_copies(odd, hot_share=0.0, hot_rows=hot_rows).collect()
    groups = {}
    for row in odd_rows:
        groups.setdefault((row[1] or "").translate(brute.LOWER), []).append(row[0])
    assert len(got) == len(odd_rows)
    for r in got:
        norm = (r["row"]["text"] or "").translate(brute.LOWER)
        ids = groups[norm]
        assert (r["keep_id"], r["group_size"]) == (max(i for i in ids if i is not None), len(ids))
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    kept = sorted((r["row"]["text"] or "").translate(brute.LOWER) for r in got if r["kept"])
    assert kept == sorted(groups)
    assert all(r["row"]["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_unique_texts_keep_columns(odd, none):
    assert exact_dedup.unique_texts(odd).columns == odd.columns
    assert exact_dedup.unique_texts(none).count() == 0


def test_near_copies_of_awkward_rows(odd, odd_rows):
    got = near_dedup.label_near_copies(odd)
    plain = brute.near_components({r[0]: r[1] for r in odd_rows if r[0] is not None}.items())
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == plain[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (1, 12, False)
    assert near_dedup.distinct_documents(odd).columns == odd.columns


def test_near_copies_of_empty_table(none):
    assert near_dedup.label_near_copies(none).count() == 0


@pytest.mark.parametrize("small,block", [(32, 256), (2, 4)])
def test_near_copies_in_a_crowd(spark, small, block):
    """Mutated copies of a few bases, of which many are alike and many are not quite."""
    rng = random.Random(small)
    docs = []
    for base in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(60):
            own = list(words)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(len(own))] = f"m{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    got = near_dedup.label_near_copies(spark.createDataFrame(docs, "doc_id long, text string"), small=small, block=block)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.near_components(docs)


def test_near_copies_of_documents(documents):
    got = near_dedup.label_near_copies(documents, words=5, percent=80)
    want = brute.near_components(pairs_of(documents), 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    rng.shuffle(chain)
    got = components.connected_components(spark.createDataFrame([*chain, (7, 7)], "a long, b long"))
    assert {(r["node"], r["root"]) for r in got.collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}
    assert got.count() == 71


def test_merged_runs_are_sorted_and_know_their_prefixes():
    rng = random.Random(2)
    for count in (0, 1, 2, 3, 5, 8):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))) for _ in range(count)]
        merged = list(suffix_runs.merge_runs([suffix_runs.front_decode(*suffix_runs.front_code(run)) for run in runs]))
        assert [s for _, _, s in merged] == sorted(s for run in runs for s in run)
        before = b""
        for n, (_, shared, suffix) in enumerate(merged):
            assert shared == (suffix_runs.common_prefix(before, suffix) if n else 0)
            before = suffix
        for r, run in enumerate(runs):
            assert [s for k, _, s in merged if k == r] == run


def repeats_in(df):
    return sorted(map(tuple, suffix_dedup.repeat_digests(df).collect()), key=repr)


def test_repeats_of_awkward_rows(odd, odd_rows):
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute.without_repeats([(r[0], r[1]) for r in order])
    got = repeats_in(suffix_dedup.remove_repeats(odd, block_bytes=4000, range_hashes=20, range_suffixes=5))
    assert got == sorted(want, key=repr)


def test_repeats_of_empty_table(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_of_documents(documents):
    want = brute.without_repeats(pairs_of(documents))
    got = repeats_in(suffix_dedup.remove_repeats(documents, block_bytes=50_000, range_hashes=500, range_suffixes=200))
    assert got == sorted(want, key=repr)


def test_repeats_in_periodic_text(spark):
    rng = random.Random(3)
    docs = []
    for i in range(40):
        parts = [rng.choice(["ab" * 60, "x" * 130, "passage " * 20, "".join(rng.choice("abc") for _ in range(90))]) for _ in range(4)]
        docs.append((i, "".join(parts)))
    got = repeats_in(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=2000))
    assert got == sorted(brute.without_repeats(docs), key=repr)


def test_quality_of_awkward_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (11, 1), (14, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge_quality(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(r["kept"] and r["bits"] is None for r in got if not r["row"]["text"])
    assert quality.good_documents(odd, labels).columns == odd.columns
    assert quality.judge_quality(none, labels).count() == 0
    untrained = quality.judge_quality(odd, labels.limit(0)).collect()
    assert len(untrained) == len(got) and all(r["kept"] for r in untrained)


def test_quality_sharded_as_small(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    key = F.col("row")["doc_id"].alias("doc_id")
    a = {r["doc_id"]: r for r in quality.judge_quality(documents, labels).select(key, "bits", "kept").collect()}
    b = {r["doc_id"]: r for r in quality.judge_quality(documents, labels, small=0).select(key, "bits", "kept").collect()}
    assert a.keys() == b.keys()
    for i, r in a.items():
        assert r["kept"] == b[i]["kept"] and (r["bits"] or 0) == pytest.approx(b[i]["bits"] or 0, abs=1e-9)


def test_probabilities_add_up(spark):
    """Over all known characters and one unknown, the probabilities after any context add up to one."""
    import numpy as np

    texts = spark.createDataFrame([("abracadabra",), ("abba cab",), (None,)], "text string")
    table = quality.train_model(texts, order=3).toPandas()
    model = quality.Model(table["kind"].to_numpy(), table["gram"].to_numpy(), table["value"].to_numpy())
    for context in ("ab", "zz", "a "):
        grams, _ = quality.ngrams([context + c for c in "abrcd z"], 3)
        last = grams.reshape(7, 3)[:, 2]
        assert np.exp2(-model.bits(last)).sum() == pytest.approx(1.0)


CORPORA = {
    "prose": ["the cat sat on the mat", "a cat and a hat", "mats and hats", "that is that", ""],
    "one": ["abababab"],
    **{f"{n} copies": ["some words stand here", "and others there"] * n for n in (2, 3, 4, 5, 6)},
}


@pytest.mark.parametrize("order", [2, 3, 5])
def test_model_as_in_dictionaries(spark, order):
    """All corpora in one call, as halves of models of their own; bits of other texts, seen or not, are finite and the same."""
    import numpy as np

    names = list(CORPORA)
    rows = [(i, text) for i, name in enumerate(names) for text in CORPORA[name]]
    table = quality.train_model(spark.createDataFrame(rows, "half int, text string"), order).toPandas()
    for i, name in enumerate(names):
        own = table[table["half"] == i]
        model = quality.Model(own["kind"].to_numpy(), own["gram"].to_numpy(), own["value"].to_numpy())
        plain = brute.kneser_ney(CORPORA[name], order)
        for text in ("abb", "the cats", "zz", "some words stand there", "a", "ababab"):
            grams, _ = quality.ngrams([text], order)
            padded = "\2" * (order - 1) + text
            want = [plain(padded[j : j + order]) for j in range(len(text))]
            got = model.bits(grams)
            assert np.isfinite(got).all() and got == pytest.approx(want)


def test_quality_of_copied_rows(spark):
    """Rows that repeat leave no discount by counts of counts; nothing overflows and all scores are finite."""
    base = ["some words stand here and there", "others stand elsewhere", "and words of all kinds follow", "abababab"]
    texts = [t for t in base for _ in range(4)] + ["abb", "quite another text", None, ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(16)], "doc_id long, quality int")
    got = quality.judge_quality(docs, labels).collect()
    assert len(got) == len(texts)
    assert all(r["bits"] is None or 0 < r["bits"] < 60 for r in got)


@pytest.mark.parametrize("bits", [16, 26])
def test_bitmap_lets_all_trusted_pass(spark, bits):
    rows = spark.range(-500, 20_000).withColumnRenamed("id", "_id").withColumn("_bucket", F.lit("clash"))
    trusted = rows.filter("_id % 7 = 3").select("_id")
    got = quality.maybe_trusted(rows.drop("_bucket"), trusted, bits=bits)
    assert trusted.exceptAll(got).count() == 0
    assert bits == 16 or got.count() < 1.01 * trusted.count()
    assert quality.maybe_trusted(rows.drop("_bucket"), trusted.limit(0)).count() == 0


def test_links_are_confirmed_in_slices():
    sets = [np.arange(i % 50, i % 50 + 300, dtype=np.uint64).tobytes() for i in range(5000)]
    names = ["a", "b", "_left", "_right"]
    ids = [str(i).encode() for i in range(len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (ids, ids[::-1], sets, sets[::-1])], names=names)
    tracemalloc.start()
    found = pa.Table.from_batches(list(near_dedup._compared(85)([batch])))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = [i for i in range(len(sets)) if 100 * (300 - (d := abs(i % 50 - (len(sets) - 1 - i) % 50))) >= 85 * (300 + d)]
    assert found["a"].to_pylist() == [ids[i] for i in near] and 0 < len(near) < len(sets)
    assert held < batch.nbytes / 4


def test_quality_takes_texts_in_stretches(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab é日", k=rng.randrange(30))) for _ in range(200)] + ["", "x" * 500, ""]
    taken, make = [], quality.ngrams
    monkeypatch.setattr(quality, "ngrams", lambda some, order: taken.append(sum(len(t.encode()) for t in some)) or make(some, order))
    want = np.unique(make(texts, 3)[0], return_counts=True)
    ranges = list(common.stretches(pa.array(texts), 100))
    assert [a for a, _ in ranges] + [len(texts)] == [0] + [b for _, b in ranges]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(texts)], names=["half", "text"])
    monkeypatch.setattr(quality, "STRETCH", 100)
    (got,) = quality._counted(3)([batch])
    assert got["gram"].to_pylist() == want[0].astype(np.int64).tolist() and got["n"].to_pylist() == want[1].tolist()
    assert max(n for n in taken if n != 500) <= 100


def test_quality_held_out(spark):
    """Documents without any part in training: nearly all clean ones stay, most poor ones go."""
    directory = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{directory}/{n}.parquet") for n in ("documents", "labels"))
    shown = labels.filter("doc_id % 2 = 0")
    judged = quality.judge_quality(docs, shown).select(F.col("row")["doc_id"].alias("doc_id"), "kept")
    rest = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r["quality"]: r["kept"] for r in rest.collect()}
    assert share[1] >= 0.95 and share[0] <= 0.3


@pytest.mark.parametrize("shown", [0, 8])
def test_quality_of_rare_languages(spark, shown):
    """A language with few labels or none keeps nearly all its clean documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    spanish = docs.filter("lang = 'es'").select("doc_id")
    few = labels.join(spanish, "doc_id", "left_semi").filter("quality = 1").orderBy("doc_id").limit(shown)
    used = labels.join(spanish, "doc_id", "left_anti").unionByName(few)
    judged = quality.judge_quality(docs, used).select(F.col("row")["doc_id"].alias("doc_id"), "kept")
    clean = judged.join(spanish, "doc_id").join(labels.filter("quality = 1"), "doc_id")
    assert clean.agg(F.avg(F.col("kept").cast("int"))).first()[0] >= 0.95


def test_quality_threshold_is_the_quantile(spark):
    """One far score does not move it; of few scores the largest is moved outwards."""
    scores = [("many", 2.0 + i / 1000) for i in range(199)] + [("many", 9.0)] + [("few", 2.0 + i / 10) for i in range(11)]
    scores += [("none", 1.0)] * 9
    limits = quality.thresholds(quality.binned(spark.createDataFrame(scores, "lang string, bits double")))
    found = {r["lang"]: r["threshold"] for r in limits.collect()}
    assert found.keys() == {"many", "few"}
    assert found["many"] == pytest.approx(2.198, abs=0.002) and 3.1 < found["few"] < 3.5


def test_quality_tells_wide_characters_apart():
    """Han and Hangul characters that are a multiple of 1024 apart have n-grams of their own; others keep one code."""
    texts = ["a" + chr(0x4E00 + 1024 * k) + "b" + chr(0xAC00 + 1024 * k) for k in range(5)] + ["ab\u0bff", "", chr(0x10FFFF)]
    grams, lengths = quality.ngrams(texts)
    assert lengths.tolist() == [6] * 5 + [3, 0, 2] and len(grams) == lengths.sum()
    assert len({tuple(grams[6 * k : 6 * k + 6]) for k in range(5)}) == 5
    one = [quality.ngrams([text])[0].tolist() for text in texts]
    assert grams.tolist() == sum(one, [])


def test_repeats_of_a_frequent_passage(spark, monkeypatch):
    """A passage in all documents, each time in other surroundings, does not come together in one range."""
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdef ") for _ in range(size)) for size in (53, 110, 150)]
    tails = ["".join(rng.choice("xyz ") for _ in range(60)) for _ in range(4)]
    docs = []
    for i in range(120):
        noise = ["".join(rng.choice("klmnop ") for _ in range(rng.randrange(40, 90))) for _ in range(4)]
        docs.append((i, "".join([noise[0], passages[i % 3], rng.choice(tails), noise[1], passages[1], noise[2], passages[2], noise[3]])))
    merge_range = suffix_dedup._merge_range

    def limited(length, gram):
        merge = merge_range(length, gram)

        def checked(key, group):
            import pickle
            import zlib

            count = sum(len(pickle.loads(zlib.decompress(raw))[1]) for raw in group["run"].to_pylist())
            if count > 100:
                raise ValueError(f"{count} suffixes in one range")
            return merge(key, group)

        return checked

    monkeypatch.setattr(suffix_dedup, "_merge_range", limited)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(table, block_bytes=5000, range_suffixes=5, hot_kinds=20)
    assert repeats_in(got) == sorted(brute.without_repeats(docs), key=repr)


def test_mix_whose_rest_ends_with_a_slice(spark):
    """Twelve equal documents of which the target takes ten: two stay out, whatever slices they fall into."""
    docs = [(i, "word " * 100, "a") for i in range(12)] + [(20, "word " * 200, "b")]
    got = mixing.sample_mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken = {s: sum(r["size"] * r["copies"] for r in got if r["row"]["source"] == s) for s in "ab"}
    assert {r["row"]["source"]: r["target"] for r in got} == {"a": 1000.0, "b": 400.0} and taken == {"a": 1000, "b": 400}


def test_near_copies_leave_one_of_each_component(spark):
    """Null, shared and repeated identifiers: one row stays of each group of near copies, and every row without words."""
    rng = random.Random(8)

    def near(words):
        own = list(words)
        own[rng.randrange(len(own))] = "changed"
        return " ".join(own)

    bases = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(4)]
    docs = [(None, near(bases[0]), str(i)) for i in range(6)] + [(7, near(bases[1]), str(i)) for i in range(6)]
    docs += [(8, " ".join(bases[2]), "a"), (8, " ".join(bases[2]), "b"), (8, " ".join(bases[2]), "b"), (9, near(bases[2]), "c")]
    docs += [(None, near(bases[3]), "x"), (3, near(bases[3]), "y"), (1, "", "e"), (None, " ", "e"), (None, " ", "e")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = near_dedup.distinct_documents(table)
    rows = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert kept.columns == table.columns and len(set(rows) - set(docs)) == 0
    assert [r[0] for r in rows if r[1].strip()].count(None) == 1
    assert sorted(r[0] for r in rows if r[1].strip() and r[0] is not None) == [3, 7, 8]
    assert sorted(r[1] for r in rows if not r[1].strip()) == ["", " ", " "]


BLOCK_IN_A_WORKER = """
import random

import pyarrow as pa

from hitgrain.llm import suffix_dedup as S


def resident(name):
    status = dict(line.split(":", 1) for line in open("/proc/self/status").read().splitlines())
    return int(status[name].split()[0]) >> 10


chance = random.Random(7)
words = ["".join(chance.choices("abcdefghij", k=7)) for _ in range(2000)]
text = " ".join(chance.choices(words, k=1000))
count = S.BLOCK_BYTES // len(text)
near = [text[: 8 * k] + "!" + text[8 * k :] for k in range(count)]
docs = pa.table({"ref": list(range(count)), "doc": list(range(count)), "tie": list(range(count)), "text": near})
key = (pa.scalar(0, pa.int32()),)
S.give_back()
open("/proc/self/clear_refs", "w").write("5")
before = resident("VmRSS")
sent = S._of_group(S._sent_hashes(50, S.LENGTH))(key, docs)
heard = pa.table({"block": [0] * len(sent), "heard": sent["hashes"]})
found = S._of_block(S._candidates(S.LENGTH))(key, docs, heard)
runs = S._of_block(S._sent_runs(1, S.LENGTH))(key, docs, found.slice(0, S.RANGE_SUFFIXES))
merged = S._of_group(S._merge_range(S.LENGTH, S.GRAM))(key, runs)
peak = resident("VmHWM")
del sent, heard, found, runs, merged
S.give_back()
print(peak - before)
"""


def test_a_worker_holds_a_block_and_a_range_of_suffixes_in_little_memory():
    found = subprocess.run([sys.executable, "-c", BLOCK_IN_A_WORKER], capture_output=True, text=True, check=True, timeout=120,
                           env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])})
    assert int(found.stdout) < 190  # MB; 16 MB of text and 50 000 suffixes took 271
