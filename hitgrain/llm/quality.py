"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

The model has order ``ORDER``. Counts of the longest n-grams are gathered from all trusted documents; shorter orders
count the distinct characters to their left. Each order has its three discounts, and its probabilities are joined from
counts, contexts and the order below, all sharded by n-gram. Where counts of counts give no discount between 0 and the count, as
in corpora of copies, it is ``FALLBACK`` of the count, so that every character has a positive probability. A document's score is
its mean number of bits per character. Characters from U+0C00 on count as two symbols of an n-gram each, so that all
characters differ. Texts fall into two halves by their hash, and each half is scored by the model of the other half's
trusted texts, so no document is scored by a model that has seen it. Documents above the quantile ``UPPER`` of the trusted
documents of their language are rejected. Below 1 / (1 - UPPER) documents that quantile lies beyond the largest, which
is then moved away from the median as far as the tail of a normal distribution says. A language with fewer than
``LEAST_TRUSTED`` trusted documents takes its quantile from all its documents.

Scale: counts are combined per Arrow batch and again before their shuffle. Tasks take texts in stretches of ``STRETCH`` bytes. The model is as large as the number of
different n-grams, which saturates. Up to ``SMALL_MODEL`` entries (checked, 16 bytes each) it is handed to the
scoring tasks, and texts are not shuffled for scoring. A larger model stays sharded: the n-grams of each document are
joined to it order by order. Both ways give the same scores.

Defined results: a null or empty text has null bits and is kept, since nothing speaks against it. A null
language is a language of its own. Fewer than ``LEAST_TRUSTED`` documents of a language have no threshold and are kept.
A half without a model has null bits and is kept; without any trusted text everything is kept. Trusted documents are
those whose labels all have quality 1. Rows that repeat are scored each, and each trains; equal texts have equal scores.
"""

from __future__ import annotations

import functools
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hitgrain.llm.common import ROW, give_back, stretches, text_or_empty, unwrapped, wrapped
from hitgrain.session import stage_table

ORDER = 5
BITS = 12
# Bytes of text whose n-grams a task holds at a time, at some ten arrays of 8 bytes each.
STRETCH = 1 << 18
SMALL_MODEL = 4_000_000
# So many documents of a language set its threshold at least.
LEAST_TRUSTED = 10
UPPER = 0.99
# Thresholds are read from histograms of this many bins per bit.
BINS = 1000
BEGIN = 2
# Places of the bitmap that tells trusted identifiers from most others: 2 ** 26.
FILTER_BITS = 26
# Share of a count that is its discount where the counts of counts give none.
FALLBACK = 0.5
# Characters from here on are two codes of BITS bits: 3072 and more, and LOW_BITS lower bits.
WIDE = 3072
LOW_BITS = 11


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ``order - 1`` begin marks, and the number of codes of each.

    A character from ``WIDE`` on has two codes: one of its upper bits, which no other character has, and one of its lower.
    """
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    wide = chars >= WIDE
    if wide.any():
        before = np.concatenate([[0], wide.cumsum()])
        ends = lengths.cumsum()
        lengths = lengths + before[ends] - before[ends - lengths]
        parts = np.repeat(chars, 1 + wide)
        at = np.flatnonzero(wide) + np.arange(wide.sum())
        parts[at] = WIDE + (chars[wide] >> np.uint64(LOW_BITS))
        parts[at + 1] = chars[wide] & np.uint64((1 << LOW_BITS) - 1)
        chars = parts
    pad = order - 1
    out = np.full(len(chars) + pad * len(texts), BEGIN, dtype=np.uint64)
    out[np.arange(len(chars)) + np.repeat(np.arange(1, len(texts) + 1) * pad, lengths)] = chars
    return out, lengths


def ngrams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each code, in order, and the number of codes of each text; most characters are one."""
    codes, lengths = _codes(texts, order)
    total = len(codes) - order + 1
    if total <= 0:
        return np.array([], dtype=np.uint64), lengths
    grams = np.zeros(total, dtype=np.uint64)
    for k in range(order):
        grams = (grams << np.uint64(BITS)) | codes[k : k + total]
    # Windows that run from one text into the begin marks of the next end in a mark.
    ends = np.ones(len(codes), dtype=bool)
    at = np.concatenate([[0], (lengths + order - 1).cumsum()[:-1]])
    for k in range(order - 1):
        ends[at + k] = False
    return grams[ends[order - 1 :]], lengths


def half(text: Column) -> Column:
    """The half, 0 or 1, that a text belongs to."""
    return F.pmod(F.xxhash64(text, F.lit("half")), F.lit(2)).cast("int")


def _tallied(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of all texts, ascending, with their counts."""
    parts = [np.unique(ngrams(texts[a:b].to_pylist(), order)[0], return_counts=True) for a, b in stretches(texts, STRETCH)]
    if len(parts) == 1:
        return parts[0]
    unique, place = np.unique(np.concatenate([grams for grams, _ in parts]), return_inverse=True)
    counts = np.zeros(len(unique), dtype=np.int64)
    np.add.at(counts, place, np.concatenate([counts for _, counts in parts]))
    return unique, counts


def _counted(order: int):
    def count(batches):
        for batch in batches:
            own = np.asarray(batch["half"])
            for side in np.unique(own).tolist():
                unique, counts = _tallied(batch["text"].filter(pa.array(own == side)), order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unique), side, np.int32)), pa.array(unique.astype(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["half", "gram", "n"],
                )
        give_back()

    return count


def train_model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (``half``, ``kind``, ``gram``, ``value``) from a table with ``text``, and ``half`` if there are two models.

    Kind k > 0 holds the probability of the last character of an n-gram of length k, kind -k the weight that a
    context leaves to the order below, kind 0 the probability of a character never seen.
    """
    side = F.col("half") if "half" in texts.columns else F.lit(0)
    grams = texts.select(side.alias("half"), text_or_empty(F.col("text")).alias("text"))
    grams = grams.mapInArrow(_counted(order), "half int, gram long, n long")
    counts = {order: stage_table(grams.groupBy("half", "gram").agg(F.sum("n").alias("n")), "lm-counts")}
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        counts[k] = stage_table(counts[k + 1].groupBy("half", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lm-counts")
    model, below = [], None
    for k in range(1, order + 1):
        cut = _discount(counts[k])
        context = F.shiftright("gram", BITS)
        contexts = counts[k].groupBy("half", context.alias("_context")).agg(F.sum("n").alias("_all"), F.sum(cut).alias("_cut"))
        joined = counts[k].withColumn("_context", context).join(contexts, ["half", "_context"])
        own, left = (F.col("n") - cut) / F.col("_all"), F.col("_cut") / F.col("_all")
        if k == 1:
            # All characters share what is left, and so does one that was never seen.
            share = left / (F.count(F.lit(1)).over(Window.partitionBy("half", "_context")) + 1)
            rows = joined.select("half", "gram", (own + share).alias("value"), share.alias("_unseen"))
            rows = stage_table(rows, "lm-order")
            unseen = rows.groupBy("half").agg(F.max("_unseen").alias("value"))
            model.append(unseen.select("half", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("gram"), "value"))
            below = rows.drop("_unseen")
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))
            lower = below.select("half", F.col("gram").alias("_suffix"), F.col("value").alias("_lower"))
            rows = joined.withColumn("_suffix", suffix).join(lower, ["half", "_suffix"])
            below = stage_table(rows.select("half", "gram", (own + left * F.col("_lower")).alias("value")), "lm-order")
            weights = contexts.select("half", F.col("_context").alias("gram"), (F.col("_cut") / F.col("_all")).alias("value"))
            model.append(weights.select("half", F.lit(-k).alias("kind"), "gram", "value"))
        model.append(below.select("half", F.lit(k).alias("kind"), "gram", "value"))
    return stage_table(functools.reduce(DataFrame.unionByName, model), "lm-model")


def _discount(counts: DataFrame) -> Column:
    """Modified Kneser-Ney discount of ``n``: three values of each half from its counts of counts, each between 0 and its count."""
    tallies = counts.groupBy("half").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    found = F.lit(None).cast("double")
    for tally in tallies:
        n = [tally[f"n{i}"] for i in (1, 2, 3, 4)]
        base = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        cuts = [i - (i + 1) * base * (n[i] / n[i - 1]) if n[i - 1] else 0.0 for i in (1, 2, 3)]
        # Corpora with many copies may have no such discount; without one a context would leave nothing to the order below.
        cuts = [cut if 0.0 < cut < i else FALLBACK * i for i, cut in enumerate(cuts, 1)]
        own = F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
        found = F.when(F.col("half") == tally["half"], own).otherwise(found)
    return found


class Model:
    """A model in sorted arrays."""

    def __init__(self, kinds: np.ndarray, grams: np.ndarray, values: np.ndarray):
        self.unseen = float(values[kinds == 0][0]) if (kinds == 0).any() else 1.0
        self.tables = {}
        for kind in np.unique(kinds[kinds != 0]).tolist():
            own = kinds == kind
            order = np.argsort(grams[own])
            self.tables[kind] = (grams[own][order].astype(np.uint64), values[own][order])
        self.order = max(self.tables, default=0)

    def _find(self, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[at] == grams, values[at]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last character of each n-gram of full length."""
        chance = np.full(len(grams), self.unseen)
        for k in range(1, self.order + 1):
            part = grams & np.uint64((1 << (BITS * k)) - 1)
            if k > 1:
                known, left = self._find(-k, part >> np.uint64(BITS))
                chance = np.where(known, left * chance, chance)
            hit, value = self._find(k, part)
            chance = np.where(hit, value, chance)
        return -np.log2(chance)


def _scored(shared, order: int, field: str | None):
    def score(batches):
        models = shared.value
        for batch in batches:
            body = batch["_text"] if field is None else pc.fill_null(batch[ROW].field(field), "")
            for at, to in stretches(body, STRETCH):
                some, part = batch.slice(at, to - at), body[at:to]
                halves, bits = np.asarray(some["_half"]), np.full(some.num_rows, np.nan)
                for side, model in models.items():
                    own = halves != side
                    texts = part.filter(pa.array(own)).to_pylist()
                    grams, lengths = ngrams(texts, order)
                    chars = np.array([len(text) for text in texts], np.int64)
                    unique, place = np.unique(grams, return_inverse=True)
                    owner = np.repeat(np.arange(len(lengths)), lengths)
                    sums = np.bincount(owner, weights=model.bits(unique)[place], minlength=len(lengths))
                    bits[own] = np.where(chars > 0, sums / np.maximum(chars, 1), np.nan)
                names = [name for name in some.schema.names if name not in ("_text", "_half")]
                scores = pa.array(bits, mask=np.isnan(bits))
                yield pa.RecordBatch.from_arrays([some[name] for name in names] + [scores], names=[*names, "bits"])
        give_back()

    return score


def small_model(model: DataFrame, small: int = SMALL_MODEL):
    """The models of both halves for the scoring tasks, or None if they have more than ``small`` entries.

    Arrow batches keep what passes the driver at 20 bytes an entry.
    """
    if model.count() > small:
        return None
    models = {}
    for side in (0, 1):
        table = model.filter(F.col("half") == side).select("kind", "gram", "value").toArrow()
        if table.num_rows:
            models[side] = Model(*[table[name].to_numpy() for name in ("kind", "gram", "value")])
    return model.sparkSession.sparkContext.broadcast(models)


def score_documents(rows: DataFrame, model: DataFrame, shared, order: int = ORDER, field: str | None = None) -> DataFrame:
    """The columns of ``rows`` but ``_text``, with its ``bits`` per character by the model of the half that it is not in.

    Null for an empty text, and where that half has no model. ``field`` names a field of ``row`` with the same text, or null
    where that is empty; the scoring tasks then get each text once.
    """
    if shared is None:
        return _score_sharded(rows, model, order)
    schema = rows.drop("_text").withColumn("bits", F.lit(None).cast("double")).schema
    halved = rows.withColumn("_half", half(F.col("_text")))
    return (halved.drop("_text") if field else halved).mapInArrow(_scored(shared, order, field), schema)


def _score_sharded(rows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The n-grams of each text are joined to the shards of the model, the longest order first."""
    key = F.sha2("_text", 256)

    def counted(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                grams, _ = ngrams(batch["_text"].slice(at, 1).to_pylist(), order)
                unique, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["_key"][at].as_py()] * len(unique), pa.string()),
                        pa.array([batch["half"][at].as_py()] * len(unique), pa.int32()),
                        pa.array(unique.astype(np.int64)),
                        pa.array(counts),
                    ],
                    names=["_key", "half", "gram", "n"],
                )

    unseen = model.filter("kind = 0").select("half", F.col("value").alias("_unseen"))
    texts = rows.select(key.alias("_key"), (1 - half(F.col("_text"))).alias("half"), "_text").dropDuplicates(["_key"])
    texts = texts.join(F.broadcast(unseen), "half", "left_semi").select("_key", "half", "_text")
    open_grams = texts.mapInArrow(counted, "_key string, half int, gram long, n long").withColumn("_left", F.lit(1.0))
    found = []
    for k in range(order, 0, -1):
        own = model.filter(F.col("kind") == k).select("half", "gram", F.col("value").alias("_p"))
        looked = open_grams.join(own, ["half", "gram"], "left")
        found.append(looked.filter("_p is not null").select("_key", "n", F.log2(F.col("_left") * F.col("_p")).alias("_bits")))
        missed = looked.filter("_p is null").drop("_p")
        if k > 1:
            weights = model.filter(F.col("kind") == -k).select("half", F.col("gram").alias("_context"), F.col("value").alias("_w"))
            open_grams = (
                missed.withColumn("_context", F.shiftright("gram", BITS))
                .join(weights, ["half", "_context"], "left")
                .withColumn("_left", F.col("_left") * F.coalesce("_w", F.lit(1.0)))
                .withColumn("gram", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)))
                .drop("_context", "_w")
            )
        else:
            missed = missed.join(F.broadcast(unseen), "half")
            found.append(missed.select("_key", "n", F.log2(F.col("_left") * F.col("_unseen")).alias("_bits")))
    scores = functools.reduce(DataFrame.unionByName, found).groupBy("_key").agg(
        (-F.sum(F.col("n") * F.col("_bits"))).alias("bits")
    )
    joined = rows.withColumn("_key", key).join(scores, "_key", "left")
    return joined.withColumn("bits", F.col("bits") / F.length("_text")).drop("_key", "_text")


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Identifiers all of whose labels say quality 1."""
    return labels.groupBy(doc_id).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_worst")).filter("_worst = 1").select(doc_id)


def maybe_trusted(rows: DataFrame, trusted: DataFrame, key: str = "_id", bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` may be among the trusted ones, by a bitmap of hashes: all that are, and few others.

    The bitmap has ``2 ** bits`` places, 8 MB, however many identifiers there are, and goes to every task. So texts without trust
    need no shuffle, until the identifiers fill the bitmap and it lets all pass.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits)) + 1
    bitmaps = trusted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
    bitmaps = bitmaps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap"))
    marked = rows.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    position = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1
    return marked.join(F.broadcast(bitmaps), "_bucket").filter(is_set).drop("_place", "_bucket", "_bitmap")


def binned(scores: DataFrame) -> DataFrame:
    """``lang``, ``bin`` and ``count`` from (``lang``, ``bits``)."""
    return scores.filter("bits is not null").groupBy("lang", F.floor(F.col("bits") * BINS).alias("bin")).count()


def _stretch(count: Column, upper: float, least: int) -> Column:
    """How many times further from the median than the largest of ``count`` scores the quantile is; 1 if they reach it."""
    place = NormalDist().inv_cdf
    few = [place(upper) / place(n / (n + 1)) for n in range(least, round(1 / (1 - upper)))]
    return F.coalesce(F.get(F.array(*map(F.lit, few)), (count - least).cast("int")), F.lit(1.0))


def thresholds(bins: DataFrame, upper: float = UPPER, least: int = LEAST_TRUSTED) -> DataFrame:
    """``lang`` and ``threshold`` of each language with ``least`` scores."""
    group = Window.partitionBy("lang")
    so_far = F.sum("count").over(group.orderBy("bin")) / F.sum("count").over(group)
    value = (F.col("bin") + 1) / BINS
    return (
        bins.withColumn("_so_far", so_far)
        .groupBy("lang")
        .agg(
            F.sum("count").alias("_n"),
            F.min(F.when(F.col("_so_far") >= 0.5, value)).alias("_median"),
            F.min(F.when(F.col("_so_far") >= upper, value)).alias("_upper"),
        )
        .filter(F.col("_n") >= least)
        .withColumn("_stretch", _stretch(F.col("_n"), upper, least))
        .select("lang", (F.col("_median") + F.col("_stretch") * (F.col("_upper") - F.col("_median"))).alias("threshold"))
    )


def judge_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", small: int = SMALL_MODEL
) -> DataFrame:
    """``row`` (the input row), ``bits``, ``perplexity``, ``threshold`` and ``kept`` of every document."""
    body = text_or_empty(F.col(ROW)[text])
    own_lang = F.col(ROW)[lang].cast("string")
    rows = wrapped(docs)
    trusted = trusted_ids(labels.select("doc_id", "quality")).withColumnRenamed("doc_id", "_id")
    vouched = rows.select(F.col(ROW)[doc_id].alias("_id"), own_lang.alias("lang"), body.alias("text"))
    trusted = stage_table(trusted, "lm-trusted-ids")
    # Trusted identifiers are distinct. A semi join would be moved below the bitmap and would shuffle all texts.
    vouched = maybe_trusted(vouched, trusted).join(trusted, "_id")
    vouched = stage_table(vouched.select("lang", "text"), "lm-trusted")
    model = train_model(vouched.withColumn("half", half(F.col("text"))))
    shared = small_model(model, small)
    field = next((f.name for f in docs.schema if f.name == text and isinstance(f.dataType, StringType)), None)
    scored = score_documents(rows.withColumn("_text", body), model, shared, field=field)
    sure = stage_table(thresholds(binned(score_documents(vouched.withColumnRenamed("text", "_text"), model, shared))), "lm-thresholds")
    # Languages with too little trusted text go by all their documents.
    limits = sure.select(F.col("lang").alias("_lang"), "threshold")
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    if not rows.select(own_lang.alias("lang")).distinct().join(limits, same, "left_anti").isEmpty():
        rare = rows.select(own_lang.alias("lang"), body.alias("_text")).join(limits, same, "left_anti")
        rest = thresholds(binned(score_documents(rare, model, shared)))
        limits = stage_table(sure.unionByName(rest), "lm-thresholds").select(F.col("lang").alias("_lang"), "threshold")
    return (
        scored.join(limits, own_lang.eqNullSafe(F.col("_lang")), "left")
        .select(ROW, "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "threshold")
        .withColumn("kept", F.coalesce(F.col("bits") <= F.col("threshold"), F.lit(True)))
    )


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns of the input."""
    return unwrapped(judge_quality(docs, labels, **options).filter("kept"))
