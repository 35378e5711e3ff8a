"""Source divergence audit: how far the word use of sources of one language lies apart.

Terms are counted per (language, source). For a block of terms an indicator matrix has one column per (group, count
level), level 0 included, and one row per term. Its transpose times itself is, exactly, the joint table of every pair of
groups: how many terms have this level here and that level there. Each cell of a joint table is priced once,
times its number of terms.

Scale: terms are counted per task before the one shuffle of counts, which is by (language, term). Terms of like frequency
share a block, so most blocks have few levels; a block holds at most about ``FEW`` or ``MANY`` terms, whatever share of the rows
one source or term has. Column tiles of ``TILE`` bound the dense products. A block passes on one value per pair
of groups. Groups come to the blocks as rows, nothing is broadcast by size. The result has one row per ordered
pair of sources of a language, which only its number of sources bounds.

Defined results: null text, language and source count as empty. Rows that repeat are documents each. A text without terms,
however long, still makes its group occur. A language without kept terms has pair values of 0 and no term rows. Terms are
runs of letters A-Z and of characters beyond ASCII; only A-Z are lower-cased. Equal values rank by item in UTF-8 order. An
empty table gives an empty result. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.llm.common import text_or_empty
from hitgrain.session import stage_table

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# Terms of a block: many where all counts are below 2 ** RARE, few where nearly every count is a level of its own.
MANY, FEW, RARE = 1024, 128, 8
# Columns of one dense product.
TILE = 1024
# Counters are handed on when they hold so many entries, and long texts are taken in pieces of so many bytes.
ENTRIES = 1_000_000
PIECE = 1 << 22
COUNTS = "lang string, source string, term string, n long, docs long"
# Bytes of terms as they are, A-Z lower-cased, everything else a space.
_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def _pieces(raw: bytes, size: int):
    """``raw`` in pieces of about ``size`` bytes, never cut inside a term."""
    at = 0
    while len(raw) - at > size:
        end = raw.find(b" ", at + size)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def _counted(entries: int, piece: int):
    def rows(held: dict) -> pa.RecordBatch:
        out = []
        for (lang, source), (seen, n, docs) in held.items():
            out.append((lang, source, None, 0, seen))
            out.extend((lang, source, term.decode(), count, docs[term]) for term, count in n.items())
        columns = zip(*out, strict=True)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"]
        )

    def count(batches):
        held: dict = {}
        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                group = held.setdefault((lang, source), [0, Counter(), Counter()])
                group[0] += 1
                terms: set[bytes] = set()
                for part in _pieces(text.translate(_BYTES), piece):
                    words = part.split()
                    group[1].update(words)
                    terms.update(words)
                group[2].update(terms)
            if sum(len(n) for _, n, _ in held.values()) > entries:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return count


def count_terms(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", entries: int = ENTRIES, piece: int = PIECE
) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents with the term); a null term counts the group's documents."""
    columns = [text_or_empty(F.col(f"`{c}`")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    rows = docs.select(*columns, text_or_empty(F.col(f"`{text}`")).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted(entries, piece), COUNTS)
    # One shuffle serves the sums per source and those per term.
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, exactly."""
    wide = (count + F.lit(2)).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / (p + q))``."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_values(columns_group: np.ndarray, columns_share: np.ndarray, terms: np.ndarray, columns: np.ndarray, groups: int, tile: int):
    """Sum of priced joint tables of every pair of groups, as a matrix.

    The indicator matrix has its ones at (``terms``, ``columns``); columns are sorted by group.
    """
    values = np.zeros((groups, groups), dtype=np.int64)
    height, width = int(terms.max()) + 1, len(columns_group)
    starts = range(0, width, tile)
    order = np.argsort(columns, kind="stable")
    terms, columns = terms[order], columns[order]

    def indicator(start: int) -> np.ndarray:
        a, b = np.searchsorted(columns, [start, min(start + tile, width)])
        block = np.zeros((height, min(tile, width - start)), dtype=np.float32)
        block[terms[a:b], columns[a:b] - start] = 1.0
        return block

    for i in starts:
        left = indicator(i)
        for j in starts:
            if j < i:
                continue
            # Sums of at most ``height`` ones are exact in single precision up to 2 ** 24.
            joint = left.T @ (left if i == j else indicator(j))
            a, b = np.nonzero(joint)
            number = joint[a, b].astype(np.int64)
            a, b = a + i, b + j
            g, h = columns_group[a], columns_group[b]
            pairs = g < h
            p, q = columns_share[a[pairs]], columns_share[b[pairs]]
            np.add.at(values, (g[pairs], h[pairs]), number[pairs] * ((p - q) * (p - q) // (p + q)))
    return values


def _priced(tile: int):
    def price(key, table):
        lang = key[0].as_py()
        sources, group = np.unique(np.array(table["source"].to_pylist(), dtype=object), return_inverse=True)
        words, n, p = table["term"], table["n"].to_numpy(), table["p"].to_numpy()
        head = np.asarray(words.is_null())
        zero = np.zeros(len(sources), dtype=np.int64)
        zero[group[head]] = p[head]
        group, n, p = group[~head], n[~head], p[~head]
        codes = np.asarray(words.filter(pa.array(~head)).combine_chunks().dictionary_encode().indices)
        height = int(codes.max()) + 1
        # Level 0 wherever a group lacks the term.
        absent = np.ones((height, len(sources)), dtype=bool)
        absent[codes, group] = False
        t0, g0 = np.nonzero(absent)
        terms, group = np.concatenate([codes, t0]), np.concatenate([group, g0])
        n, p = np.concatenate([n, np.zeros(len(t0), np.int64)]), np.concatenate([p, zero[g0]])
        order = np.lexsort([n, group])
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(group[order]) != 0) | (np.diff(n[order]) != 0)
        values = joint_values(group[order][new], p[order][new], terms[order], new.cumsum() - 1, len(sources), tile)
        g, h = np.triu_indices(len(sources), 1)
        both = np.concatenate([g, h]), np.concatenate([h, g])
        return pa.table(
            {
                "lang": pa.array([lang] * len(both[0]), pa.string()),
                "source": pa.array(sources[both[0]].tolist(), pa.string()),
                "item": pa.array(sources[both[1]].tolist(), pa.string()),
                "value": pa.array(np.tile(values[g, h], 2)),
            }
        )

    return price


def _pair_values(kept: DataFrame, groups: DataFrame, many: int, few: int, tile: int) -> DataFrame:
    """``lang``, ``source``, ``item`` and ``value``, summed over the blocks of terms."""
    size = F.floor(F.log2(F.col("total").cast("double"))).cast("int")
    sized = kept.withColumn("_size", size)
    # One row per language and power of two.
    blocks = sized.groupBy("lang", "_size").agg(F.count_distinct("term").alias("_terms"))
    most = F.when(F.col("_size") < RARE, F.lit(many)).otherwise(F.lit(few))
    blocks = blocks.select("lang", "_size", F.ceil(F.col("_terms") / most).alias("_blocks"))
    number = F.pmod(F.xxhash64("term"), F.col("_blocks"))
    dealt = sized.join(F.broadcast(blocks), ["lang", "_size"]).select(
        "lang", "_size", number.alias("_block"), "source", "term", "n", "p"
    )
    heads = blocks.select("lang", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    heads = heads.join(groups, "lang").select(
        "lang", "_size", "_block", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("zero").alias("p")
    )
    held = dealt.select("lang", "_size", "_block").distinct()
    heads = heads.join(held, ["lang", "_size", "_block"], "left_semi")
    priced = dealt.unionByName(heads).groupBy("lang", "_size", "_block").applyInArrow(
        _priced(tile), "lang string, source string, item string, value long"
    )
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    many: int = MANY,
    few: int = FEW,
    tile: int = TILE,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair`` sets a source against every other of its language, part ``term`` names the ``top`` terms that it has more of than its language.
    """
    word = Window.partitionBy("lang", "term")
    counts = count_terms(docs, text, lang, source)
    counts = counts.withColumn("total", F.sum("n").over(word)).withColumn("_docs", F.sum("docs").over(word))
    counts = stage_table(counts.filter(F.col("term").isNull() | (F.col("_docs") >= least)).drop("docs", "_docs"), "audit-counts")
    terms = counts.filter("term is not null")
    of_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    of_lang = terms.groupBy("lang").agg(F.sum("n").alias("_all"), F.count_distinct("term").alias("_terms"))
    groups = of_source.join(of_lang, "lang", "left").withColumn("_terms", F.coalesce("_terms", F.lit(0)))
    groups = groups.withColumn(
        "zero", F.when(F.col("_terms") > 0, share(F.lit(0).cast("long"), F.col("_n"), F.col("_terms")))
    )
    groups = stage_table(groups, "audit-groups")
    kept = terms.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("_n"), F.col("_terms")))
    other = groups.select("lang", F.col("source").alias("item"))
    values = _pair_values(kept.select("lang", "source", "term", "n", "total", "p"), groups, many, few, tile)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = (
        groups.select("lang", "source")
        .join(other, "lang")
        .filter(F.col("source") != F.col("item"))
        .join(values, ["lang", "source", "item"], "left")
        .withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    )
    q = share(F.col("total"), F.col("_all"), F.col("_terms"))
    marked = (
        kept.withColumn("_q", q)
        .filter("n > 0 and p > _q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("_q")).alias("value"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
    )
    return pairs.unionByName(marked)
