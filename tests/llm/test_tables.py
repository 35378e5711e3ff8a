"""Urls, mixing, tokens, packing, archives, neighbours, and the named queries."""

from __future__ import annotations

import io
import math
import os
import random
import struct
import zipfile
import zlib

import brute
import numpy as np
import oracle
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hitgrain.llm import ann, encoder, mixing, packing, token_output, url_filter, warc_zip
from hitgrain.llm.queries import ORACLES, QUERIES, tokenizer_path
from hitgrain.session import stage_table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SMALL), SMALL, QUERIES[name], ORACLES[name]) is None


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("a.example.org/es/x", "allow"), ("net", "block"), ("net/ok", "allow"),
         ("net", "allow"), (None, "block"), ("com/d", None), ("com/de/", "block"), ("co.uk/", "block")]


def judged(url, rules):
    rest = (url or "").partition("://")[2]
    host = "".join(brute.re.split(r"[/?#]", rest)[0]).translate(brute.LOWER)
    path = brute.re.split(r"[?#]", rest[len(host) :])[0]
    fits = []
    for rule, verdict in rules:
        if rule is None or verdict is None:
            continue
        own, slash, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + tail):
            fits.append((len(rule), len(own), verdict, rule))
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    rng = random.Random(4)
    hosts = ["example.org", "A.EXAMPLE.org", "xexample.org", "b.a.example.org", "net", "x.net", "bad.co.uk", "uk", "com", "", ".org", "a..com"]
    paths = ["", "/", "/es/", "/es/x/1", "/es", "/ok", "/okay?x", "/de/1#/es/", "?/es/", "/d", "/" + "long" * 5000]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "x://", "a://b://c/"]
    rows = [(i, u, "clash") for i, u in enumerate([*urls, urls[0], urls[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string")).collect()
    assert sorted((r["row"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted(
        (i, *judged(u, RULES)) for i, u, _ in rows
    )
    without = url_filter.judge_urls(pages, spark.createDataFrame([], "rule string, verdict string"))
    assert {r["verdict"] for r in without.collect()} == {"allow"} and without.count() == len(rows)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "rule string, verdict string")).count() == 0


@pytest.mark.parametrize("slices", [1, 7, 4096])
def test_mixing(spark, odd, odd_rows, slices):
    got = mixing.sample_mix(odd, slices=slices).collect()
    sources = sorted({r[3] for r in odd_rows}, key=lambda s: (s is None, s))
    sizes = [sum(len(brute.words_of(r[1])) for r in odd_rows if r[3] == s) for s in sources]
    want = dict(zip(sources, brute.targets(sizes, mixing.WEIGHTS), strict=True))
    assert len(got) == len(odd_rows)
    for source in sources:
        own = [r for r in got if r["row"]["source"] == source]
        assert all(r["target"] == pytest.approx(want[source]) for r in own)
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - want[source]) <= max(r["size"] for r in own) / 2 + 1e-6
        # Complete epochs first, then the documents with the smallest keys.
        epochs = math.floor(want[source] / max(1, sum(r["size"] for r in own)))
        assert {r["copies"] - epochs for r in own if r["size"]} <= {0, 1}
    assert all(r["copies"] <= 3 and r["size"] == len(brute.words_of(r["row"]["text"])) for r in got)
    again = mixing.sample_mix(odd, slices=slices).collect()
    key = lambda rows: sorted((str(r["row"]["doc_id"]), r["copies"]) for r in rows)
    assert key(got) == key(again)


def plain_key(doc_id, text, seed=17):
    """The exponential key of a document: hash of seed, identifier and text, each chained on the one before."""
    inner = xxhash.xxh64_intdigest(text.encode(), 42)
    digest = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    if doc_id is not None:
        digest = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), digest)
    digest = xxhash.xxh64_intdigest(struct.pack("<Q", inner), digest)
    mean = len(text) / max(len(brute.words_of(text)), 1)
    return -math.log(((digest >> 11) + 0.5) / (1 << 53)) * (6.0 + abs(mean - 6.0)) / 6.0


def test_mixed_selection_of_query(spark):
    """Complete epochs, then documents by their keys up to the prefix sum nearest to the rest: all documents, one by one."""
    rows = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    by_source = {}
    for doc_id, text, source in rows:
        by_source.setdefault(source, []).append((plain_key(doc_id, text), doc_id, len(brute.words_of(text))))
    sources = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(size for *_, size in by_source[source]) for source in sources]
    want = {}
    for source, whole, target in zip(sources, sizes, brute.targets(sizes, mixing.WEIGHTS), strict=True):
        epochs, before = int(target // max(whole, 1)), 0
        for _, doc_id, size in sorted(by_source[source]):
            want[doc_id] = size * (epochs + (before + size / 2 <= target - epochs * whole))
            before += size
    got = {r.doc_id: r.taken for r in QUERIES["op4_mixing"](spark, SMALL).collect()}
    assert got == want
    assert 0 < sum(1 for doc_id, text, _ in rows if got[doc_id] == 0 and text) < len(rows)


def test_mixed_documents(odd, none):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.sample_mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(none).count() == 0


def test_targets_when_many_are_capped(spark):
    rng = random.Random(6)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 5, 5, 100, 10_000]) for _ in range(rng.randrange(1, 12))]
        rows = [(f"s{i:02}", n) for i, n in enumerate(sizes)]
        got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("source").collect()
        assert [r["target"] for r in got] == pytest.approx(brute.targets(sizes, mixing.WEIGHTS))


def whole_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    return [np.array([*e.ids, 0], "<u4") for e in found]


def test_encoder_on_any_text():
    rng = random.Random(7)
    pieces = [" ", "  ", "\n", "\t", "a", "Bc", "é", "12", ".", "!!", "'s", "'", "\x0b", "\u00a0", "日本", "😀", "<|endoftext|>", "\r\n", "\u180e"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(15))) for _ in range(3000)]
    got = encoder.Encoder(tokenizer_path(), keep=50).encode(texts[:1000]) + encoder.encoder(tokenizer_path()).encode(texts[1000:])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w[:-1].tolist() for w in whole_ids(texts)]


def test_packing_encodes_little_at_a_time(monkeypatch):
    taken, docs = [], pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([f"w{i} " * 2000 for i in range(400)])], names=["doc_id", "text"])
    used = encoder.Encoder(tokenizer_path())
    monkeypatch.setattr(encoder.Encoder, "encode_flat", lambda self, texts, end=b"", f=encoder.Encoder.encode_flat: taken.append(sum(map(len, texts))) or f(self, texts, end))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(encoder, "_encoders", {"v": used})
    pieces = pa.Table.from_batches(list(packing._cut("v", 1024)([docs])))
    assert len(set(pieces["doc_id"].to_pylist())) == 400
    assert max(taken) <= packing.BATCH < sum(taken) and used.keep == packing.KEEP


def test_encoder_takes_latin_words_to_the_model(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiourstnéßŁñ", k=rng.randrange(1, 12))) for _ in range(500)]
    others = ["日本", "ɐb", "x1", "a-b", "don't", "Дa", "x\u0301"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "!?"]) for _ in range(60)) + " " + " ".join(others) for _ in range(40)]
    texts += ["", "one", " led", "two  three\nfour", texts[0].replace(" ", "\n")]
    used, encode = encoder.Encoder(tokenizer_path()), encoder.Encoder._together
    joined = []
    monkeypatch.setattr(encoder.Encoder, "_together", lambda self, some: joined.extend(some) or encode(self, some))
    ids, counts = used.encode_flat(texts, np.array([0], "<u4").tobytes())
    want = whole_ids(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()
    assert not {" " + w for w in words} & set(joined)
    assert {" " + w for w in others} <= set(joined)
    assert used.encode([]) == []


def test_tokens(odd, odd_rows, none):
    got = token_output.token_digests(token_output.token_table(odd, tokenizer_path())).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for row, ids in zip(order, whole_ids([r[1] or "" for r in order]), strict=True):
        want.append((row[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.token_table(none, tokenizer_path()).count() == 0


def test_token_files(spark, odd, tmp_path):
    import pyarrow.parquet as pq

    token_output.write_tokens(odd, str(tmp_path / "t"), tokenizer_path())
    names = [n for n in os.listdir(tmp_path / "t") if n.endswith(".parquet")]
    column = [pq.ParquetFile(tmp_path / "t" / n).metadata.row_group(0) for n in names]
    by_name = [{c.column(i).path_in_schema: c.column(i) for i in range(c.num_columns)} for c in column]
    assert all(c["tokens.list.element"].has_dictionary_page for c in by_name)
    assert all("DELTA_BINARY_PACKED" in c["doc_id"].encodings and c["doc_id"].has_offset_index for c in by_name)


def scanned_rows(df):
    """Rows that the scans of a query hand on, after it has run."""
    df.collect()
    leaves, rows = df._jdf.queryExecution().executedPlan().executedPlan().collectLeaves(), []
    for i in range(leaves.size()):
        plan = leaves.apply(i)
        while "QueryStage" in plan.getClass().getSimpleName():
            inner = plan.plan().collectLeaves()
            plan = inner.apply(0)
        rows.append(plan.metrics().apply("numOutputRows").value())
    return rows


def test_tokens_are_read_selectively(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "t")
    token_output.write_tokens(docs, path, tokenizer_path())
    whole = {r["doc_id"]: r for r in token_output.read_tokens(spark, path).collect()}
    some = token_output.read_tokens(spark, path, 40, 60)
    assert {r["doc_id"]: r for r in some.collect()} == {i: r for i, r in whole.items() if 40 <= i <= 60}
    lengths = token_output.read_lengths(spark, path)
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in lengths.collect()} == {i: (r["start"], len(r["tokens"])) for i, r in whole.items()}
    # Row groups and pages of other identifiers are left out, and ids are no part of what lengths read.
    assert min(scanned_rows(some)) < len(whole) / 2
    plan = lengths._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "tokens:array" not in plan and "tokens:array" in some._jdf.queryExecution().toString()


def test_packing(odd, odd_rows, none):
    pieces = packing.pack_documents(odd, tokenizer_path()).collect()
    ids = whole_ids([r[1] or "" for r in odd_rows])
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    by_total = {}
    for row, own in zip(odd_rows, ids, strict=True):
        by_total.setdefault((row[0], len(own)), own)
    sequences = {}
    for p in pieces:
        own = by_total[(p["doc_id"], p["doc_tokens"])]
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("count", [0, 1, 300, 60_000])
def test_slots_hold_every_piece(count):
    rng = np.random.default_rng(count)
    histogram = np.bincount(rng.integers(1, 1024, count), minlength=1024)
    slots = packing.plan_slots(histogram)
    held = {}
    sequences = {}
    for length, begin, end, first, many, offset in slots:
        held.setdefault(length, []).append((begin, end))
        for s in range((end - begin) // many):
            sequences[first + s] = sequences.get(first + s, 0) + many * length
    for length, ranges in held.items():
        ranges.sort()
        assert [a for a, _ in ranges] == [0, *[b for _, b in ranges[:-1]]] and ranges[-1][1] == histogram[length]
    assert max(sequences.values(), default=0) <= 1024
    if count == 60_000:
        assert sum(sequences.values()) > 0.99 * 1024 * len(sequences)


def test_archives(spark, tmp_path):
    big = "ä" * 600
    rows = [(1, "http://a/ b\n", big), (5, None, big), (3, "u", big), (2, "x", "small"), (4, "y", "small"), (6, "z", None),
            (7, "w", "long " * 100_000), (None, "q", big), (8, "v", "x" * 999), (9, "v", "x" * 999), (10, "r\r\n\r\n", "\r\n\r\nWARC/1.1" * 100),
            (10, "r", "\r\n\r\nWARC/1.1" * 100)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc_zip.write_archives(pages, str(tmp_path), limit=500)
    assert archives.count() > 1
    read = warc_zip.read_archives(archives)
    assert {r.record_id for r in read.collect()} >= {"<urn:page:1>", "<urn:page:>"}
    got = sorted(map(tuple, read.select(*warc_zip.DIGEST).collect()), key=repr)
    import hashlib

    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        last = 5 if raw == big.encode() and page_id != 5 else None
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if last else "response", last))
    assert got == sorted(want, key=repr)
    assert warc_zip.packed_pages(pages.limit(0)).count() == 0


class Sparse(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_archive_without_index_and_plain_records():
    records = [warc_zip.record_bytes(i, "u", b"x" * i, "d", None) for i in range(3)]
    for name, pack in (("a/data.warc", bytes), ("a/data.warc.gz", warc_zip.gzip.compress)):
        file = Sparse()
        with zipfile.ZipFile(file, "w") as archive:
            archive.writestr("packed.txt", "not stored " * 100, zipfile.ZIP_DEFLATED)
            archive.writestr(name, b"".join(map(pack, records)))
        places = list(warc_zip.record_places(file))
        assert [warc_zip.parse_record(warc_zip.read_at(file, *p))[:2] for p in places] == [(0, 0), (1, 1), (2, 2)]


def record(*head, block=b""):
    return "\r\n".join(["WARC/1.0", *head, f"Content-Length:{len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_package_of_another_writer(spark, tmp_path):
    """Two data members, one index with texts as offsets, other names and types of records, revisits without sizes."""
    import hashlib

    http = b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\n"
    uuid, sha = "<urn:uuid:11111111-2222-3333-4444-555555555555>", hashlib.sha1(b"page").digest()
    b32 = warc_zip.base64.b32encode(sha).decode()
    one = [
        record("WARC-Type: warcinfo", "Content-Type: application/warc-fields", block=b"software: x\r\n"),
        record("warc-type:response", f"WARC-Record-ID: {uuid}", "Content-Type: application/http;\r\n msgtype=response", block=http + b"page"),
    ]
    two = [record("WARC-TYPE: revisit", f"WARC-Refers-To: {uuid}", f"WARC-Payload-Digest: SHA1:{b32}", "WARC-Record-ID: <urn:page:x1>")]
    members = {"archive/a.warc.gz": [warc_zip.gzip.compress(r) for r in one], "archive/b.warc": two}
    lines = ["!meta 0 {\"format\": \"x\"}", "no place"]
    for name, packed in members.items():
        at = 0
        for r in packed:
            lines.append('k 2020 {"offset": "%d", "length": "%d", "filename": "%s"}' % (at, len(r), name.rpartition("/")[2]))
            at += len(r)
    paths = [str(tmp_path / name) for name in ("indexed.zip", "walked.zip", "bare.zip")]
    for path in paths:
        with zipfile.ZipFile(path, "w") as archive:
            for name, packed in members.items() if "bare" not in path else ():
                archive.writestr(name, b"".join(packed))
            if "indexed" in path:
                archive.writestr("indexes/index.cdxj", "\n".join(lines))
    want = [
        (None, 13, hashlib.sha1(b"software: x\r\n").hexdigest(), "warcinfo", None, None),
        (None, 4, sha.hex(), "response", None, uuid),
        (None, None, sha.hex(), "revisit", None, "<urn:page:x1>"),
    ]
    archives = spark.createDataFrame([(p,) for p in paths], "path string")
    got = sorted(map(tuple, warc_zip.read_archives(archives).collect()), key=repr)
    assert got == sorted(want * 2, key=repr)


def test_zip64_directory():
    """A directory with all sizes, offsets and counts in their ZIP64 forms."""
    name, data = b"archive/data.warc", b"stored bytes"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HHH", 9, 2, 0) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    central += name + extra
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = Sparse(local + central + end64 + locator + end)
    (place,) = warc_zip.stored_members(file).values()
    assert warc_zip.read_at(file, *place) == data


def plain_neighbours(rows, queries, k):
    from fractions import Fraction

    def square(a, b):
        """The cosine, squared with its sign, exactly."""
        a, b = ([Fraction(x) for x in v] for v in (a, b))
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot * abs(dot) / (sum(x * x for x in a) * sum(y * y for y in b))

    out = {}
    for q in queries:
        mine = min(v for i, v in rows if i == q)
        out[q] = sorted((-square(mine, v), i is None, i or 0) for i, v in rows if i != q)[:k]
    return out


@pytest.mark.parametrize("slab_bytes, asked", [(1, 1), (1 << 20, 2)])
def test_neighbours_of_awkward_vectors(spark, slab_bytes, asked):
    nan, inf = float("nan"), float("inf")
    sound = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (7, [-1.0, 0.5]), (100, [1e-300, 1e-300]), (9, [3.0, 3.0])]
    sound += [(300, [1e300, -1e300]), (None, [0.5, 0.0]), (50, [0.25, 1.0]), (3, [1.0, 0.0]), (8, [5e-324, 0.0])]
    poor = [(150, None), (200, [0.0, 0.0]), (11, [nan, 1.0]), (12, [None, 1.0]), (13, [inf, 1.0]), (250, [1.0, 2.0, 3.0]), (14, [])]
    rows = spark.createDataFrame([(*r, "clash") for r in [*sound, *poor]], "vec_id long, embedding array<double>, score string")
    got = ann.nearest_neighbours(rows, lambda i: i % 50 == 0, recall=1.0, slab_bytes=slab_bytes, asked=asked).collect()
    want = plain_neighbours(sound, [0, 50, 100, 300], 5)
    assert {r["query_id"] for r in got} == want.keys()
    for q, best in want.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in own] == [None if null else i for _, null, i in best]
        for (_, _, score), (negative, _, _) in zip(own, best, strict=True):
            assert score * abs(score) == pytest.approx(-float(negative))
    assert ann.nearest_neighbours(rows.limit(0), lambda i: i % 50 == 0).count() == 0
    one = ann.nearest_neighbours(rows.filter("vec_id = 0"), lambda i: i % 50 == 0)
    assert one.count() == 0


def test_neighbours_of_one_vector_many_times(spark):
    """Half of all rows are one vector; it fills slabs of its own, and ties go by identifier."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest_neighbours(df, lambda i: i % 50 == 0, recall=1.0, slab_bytes=32 * 40, asked=3).collect()
    want = plain_neighbours(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(
        (q, n, i) for q, best in want.items() for n, (_, _, i) in enumerate(best, 1)
    )


def test_leaves_out_of_reach_are_left_out():
    """Tight clusters: what lies beyond a leaf's radius is not measured, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = np.repeat(centres, 60, axis=0) + rng.normal(size=(2400, 16)) * 0.01
    tree = ann.Tree(rows, leaf_rows=64)
    near = np.einsum("ij,ij->i", ann.unit_rows(rows), tree.leaf_centres()[tree.leaf_of(rows)])
    counts = {int(leaf): (int((tree.leaf_of(rows) == leaf).sum()), near[tree.leaf_of(rows) == leaf].min()) for leaf in range(tree.leaves)}
    slabs = ann.Slabs(tree, counts, 500)
    assert slabs.first[0] == 0 and (np.diff(slabs.first) >= 0).all()
    assert max(sum(c for leaf, (c, _) in counts.items() if slabs.first[leaf] == s) for s in set(slabs.first.tolist())) <= 500
    assert len(tree.visits(rows[0], 5)) == 5


def test_neighbours_recall(spark):
    directory = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{directory}/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in QUERIES["op10_neighbours"](spark, directory).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = table.collect()
    ids = np.array([r["vec_id"] for r in rows])
    matrix = ann.unit_rows(np.array([r["embedding"] for r in rows], dtype=float))
    found = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = matrix @ matrix[at]
        score[at] = -9
        found += len(set(ids[np.lexsort((ids, -score))[:5]].tolist()) & got[int(ids[at])])
        total += 5
    assert found >= 0.9 * total


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SMALL).localCheckpoint()
        assert kept.columns == docs.columns
        rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
        left = {r["doc_id"] for r in kept.collect()}
        if name == "exact_dedup":
            last = {(t or "").translate(brute.LOWER): i for i, t in rows}
            assert left == set(last.values())
        if name == "near_dedup":
            assert left == {i for i, (_, top) in brute.near_components(rows, 5, 80).items() if i == top}
        if name == "quality":
            clean = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
            assert len(clean & left) >= 0.95 * len(clean & {i for i, _ in rows})
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in kept.collect()}
    again = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert pieces.select(key).exceptAll(again.select(key)).count() == 0
