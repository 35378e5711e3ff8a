"""Vector code compression: product codes whose nearest entries are found by a GNAT over each codebook.

Components become integers, ``floor(4096 * x)``. A vector is cut into ``PARTS`` equal parts, and each part is coded by the
nearest of ``ENTRIES`` entries of its codebook, ties to the lower index. The codebooks begin as parts of the first vectors and are
refined in ``ROUNDS`` rounds of assigning and averaging.

Entries are searched through a GNAT (geometric near-neighbour access tree). A node has a few entries as split points, every
other entry belongs to its nearest split point, and every split point stores the least and the largest distance to the entries of every
subtree. A query measures its distance to the split points and leaves out each subtree that some range puts strictly farther away
than the best entry so far. Distances are compared as integer square roots rounded so that nothing is left out that could be
as near; what is left is compared by exact squared distance, then by index.

Scale: a round is one pass over the vectors. Tasks hand on sums per (part, entry), combined before their shuffle, and only the codebooks
(``PARTS`` x ``ENTRIES`` entries) pass the driver. No vector is shuffled. Error sums of a label are combined before
their shuffle and joined back over ``SALTS`` salts, so a label with a third of all rows spreads over tasks.

Defined results: null vectors and vectors with null or non-finite components are left out, and so are those with another number of
components than most (the smaller number of equally frequent ones). Parts have ``ceil(n / PARTS)`` components, the last ones filled up
with zeros. The first vectors are those with the smallest ``vec_id``, null last, repeated ones by their components. Fewer vectors than ``ENTRIES`` make
smaller codebooks. Rows that repeat are vectors each. Components of any finite size are exact: where squares could pass
2 ** 52, Python's integers are used. An error that is no long is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgrain.llm.common import ROW, wrapped
from hitgrain.session import stage_table

PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096
# Split points of a node, and how many entries are left without a node of their own.
SPLITS, BUCKET = 4, 3
SALTS = 32
# Rows that are coded at once.
BATCH = 4096
# Sums pass as digits to this base, so that integers of any size add up exactly in columns of longs.
BASE_BITS = 48
FAR = np.iinfo(np.int64).max


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``floor(UNIT * x)`` as exact floats where all stay small, else as Python integers."""
    scaled = np.floor(values * UNIT)
    if not scaled.size or np.abs(scaled).max() < 2.0**25:
        return scaled
    # From 2 ** 52 on a double is a whole number.
    exact = [int(x) * UNIT if abs(x) >= 2.0**52 else int(np.floor(x * UNIT)) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _small(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of the arrays are exact in doubles."""
    if any(a.dtype == object for a in arrays):
        return False
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 4.0 * most * most * max(1, arrays[0].shape[1]) < 2.0**52


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a point: longs, or Python integers where those do not do."""
    if _small(rows, point[None, :]):
        off = rows - point
        return np.einsum("ij,ij->i", off, off).astype(np.int64)
    # ``int`` also of what came as a float, so that products do not round.
    whole = [int(x) for x in point.tolist()]
    found = [sum((int(a) - b) ** 2 for a, b in zip(row, whole, strict=True)) for row in rows.tolist()]
    return np.array(found, dtype=object)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Integer square roots, rounded down or up."""
    if squares.dtype == object:
        down = [isqrt(s) for s in squares.tolist()]
        return np.array([r + (r * r < s) if up else r for r, s in zip(down, squares.tolist(), strict=True)], dtype=object)
    roots = np.sqrt(squares.astype(np.float64))
    return (np.ceil(roots) if up else np.floor(roots)).astype(np.int64)


class Gnat:
    """A GNAT over the entries of one codebook."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, bucket: int = BUCKET, index: np.ndarray | None = None):
        self.entries = entries
        index = np.arange(len(entries)) if index is None else index
        self.measured = 0
        if len(index) <= max(bucket, splits):
            self.points, self.below = index, []
            return
        self.points = self._spread(index, splits)
        rest = np.setdiff1d(index, self.points)
        gaps = np.array([squared(entries[rest], entries[p]) for p in self.points])
        owner = gaps.argmin(axis=0)
        self.below = []
        for k in range(len(self.points)):
            own = owner == k
            if not own.any():
                continue
            # Ranges of the subtree, seen from every split point.
            low = [int(_root(line[own], False).min()) for line in gaps]
            high = [int(_root(line[own], True).max()) for line in gaps]
            self.below.append((low, high, Gnat(entries, splits, bucket, rest[own])))

    def _spread(self, index: np.ndarray, splits: int) -> np.ndarray:
        """Split points far from each other: each next one is the entry farthest from those before."""
        points = [int(index[0])]
        near = squared(self.entries[index], self.entries[points[0]])
        while len(points) < splits:
            points.append(int(index[int(near.argmax())]))
            near = np.minimum(near, squared(self.entries[index], self.entries[points[-1]]))
            if len(set(points)) < len(points):
                # Only equal entries are left; any of them will do.
                points = [*points[:-1], *[i for i in index.tolist() if i not in points]][:splits]
                break
        return np.array(points)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and exact squared distance of the nearest entry of each row."""
        wide = not _small(rows, self.entries)
        best = np.full(len(rows), None if wide else FAR, dtype=object if wide else np.int64)
        code = np.full(len(rows), len(self.entries))
        self.measured = self._search(rows, np.arange(len(rows)), best, code)
        return code, best

    def _search(self, rows: np.ndarray, at: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
        gaps = []
        for point in self.points.tolist():
            gap = squared(rows[at], self.entries[point])
            if best.dtype == object:
                nearer = np.array(
                    [b is None or g < b or (g == b and point < c) for g, b, c in zip(gap.tolist(), best[at].tolist(), code[at].tolist(), strict=True)],
                    dtype=bool,
                )
                gap = gap.astype(object)
            else:
                nearer = (gap < best[at]) | ((gap == best[at]) & (point < code[at]))
            best[at[nearer]], code[at[nearer]] = gap[nearer], point
            gaps.append(gap)
        measured = len(at) * len(gaps)
        floors, ceils = [_root(g, False) for g in gaps], [_root(g, True) for g in gaps]
        for low, high, child in self.below:
            limit = _root(best[at], True)
            open_rows = np.ones(len(at), dtype=bool)
            for k in range(len(gaps)):
                # Nothing in the subtree is nearer than these; equally near is not left out.
                open_rows &= ((floors[k] - high[k] <= limit) & (low[k] - ceils[k] <= limit)).astype(bool)
            if open_rows.any():
                measured += child._search(rows, at[open_rows], best, code)
        return measured


def parts_of(matrix: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """The parts of all vectors, the last ones filled up with zeros."""
    width = max(1, -(-matrix.shape[1] // parts))
    wide = np.zeros((len(matrix), width * parts))
    wide[:, : matrix.shape[1]] = matrix
    return [wide[:, k * width : (k + 1) * width] for k in range(parts)]


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def _coded(books: list[np.ndarray], matrix: np.ndarray, trees: list[Gnat]):
    for k, part in enumerate(parts_of(matrix, len(books))):
        numbers = whole_numbers(part)
        yield k, numbers, *trees[k].nearest(numbers)


def _digits(value: int) -> list[int]:
    """``value`` to the base 2 ** BASE_BITS, lowest first; only the last digit may be negative."""
    out = []
    while not -(1 << BASE_BITS) < value < 1 << BASE_BITS:
        out.append(value & ((1 << BASE_BITS) - 1))
        value >>= BASE_BITS
    return [*out, value]


def _book(entries: list[list[int]]) -> np.ndarray:
    """A codebook as floats if they are exact, else as Python integers."""
    numbers = np.array(entries, dtype=object)
    small = all(abs(x) < 1 << 25 for x in numbers.ravel().tolist())
    return numbers.astype(np.float64) if small else numbers


def _summed(books: list[np.ndarray]):
    """Sums of the parts that each entry is nearest to; ``place`` -1 counts them."""

    def add(batches):
        trees, sums, counts = [Gnat(book) for book in books], {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for part, numbers, codes, _ in _coded(books, _matrix(batch["vector"].slice(at, BATCH)), trees):
                    for entry in np.unique(codes).tolist():
                        own = numbers[codes == entry]
                        # Up to BATCH rows of less than 2 ** 25 add up exactly in doubles.
                        total = [int(x) for x in own.sum(axis=0).tolist()]
                        before = sums.get((part, entry))
                        sums[part, entry] = total if before is None else [a + b for a, b in zip(before, total, strict=True)]
                        counts[part, entry] = counts.get((part, entry), 0) + len(own)
        rows = [(p, e, -1, 0, n) for (p, e), n in counts.items()]
        for (p, e), line in sums.items():
            rows += [(p, e, place, i, digit) for place, value in enumerate(line) for i, digit in enumerate(_digits(value))]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "digit", "value"])

    return add


SUMS = "part int, entry int, place int, digit int, value long"


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; entries that no part is nearest to stay."""
    sums = vectors.select("vector").mapInArrow(_summed(books), SUMS).groupBy("part", "entry", "place", "digit")
    # As many rows as the codebooks have components, however many vectors there are.
    rows = sums.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    totals: dict[tuple[int, int, int], int] = {}
    for part, entry, place, digit, value in rows:
        key = (part, entry, place)
        totals[key] = totals.get(key, 0) + (int(value) << (BASE_BITS * digit))
    out = []
    for part, book in enumerate(books):
        entries = [[int(x) for x in entry] for entry in book.tolist()]
        for entry, line in enumerate(entries):
            count = totals.get((part, entry, -1), 0)
            if count:
                entries[entry] = [totals[part, entry, place] // count for place in range(len(line))]
        out.append(_book(entries))
    return out


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``row`` and ``vector`` (doubles) of the rows that take part."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = wrapped(rows).withColumn("vector", F.col(ROW)[vector].cast("array<double>")).filter(sound)
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return vectors.filter(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook per part, from a table with ``vec_id`` and ``vector``."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return []
    matrix = np.array([row["vector"] for row in first], dtype=np.float64).reshape(len(first), -1)
    books = [_book([[int(x) for x in line] for line in whole_numbers(part).tolist()]) for part in parts_of(matrix, parts)]
    for _ in range(rounds):
        books = refined(vectors, books)
    return books


def codebook_digest(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position, joined by commas."""
    numbers = (str(int(x)) for book in books for entry in book.tolist() for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _encoded(books: list[np.ndarray]):
    def encode(batches):
        trees = [Gnat(book) for book in books]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                codes, errors = [], None
                for _, _, code, error in _coded(books, _matrix(some["vector"]), trees):
                    codes.append(code)
                    errors = error.astype(object) if errors is None else errors + error
                texts = ["".join(f"{c:02x}" for c in line) for line in np.array(codes).T.tolist()]
                fitting = [e if e < 1 << 63 else None for e in errors.tolist()]
                kept = [name for name in some.schema.names if name != "vector"]
                yield pa.RecordBatch.from_arrays(
                    [*(some[name] for name in kept), pa.array(texts, pa.string()), pa.array(fitting, pa.int64())],
                    names=[*kept, "code", "error"],
                )

    return encode


def encode_vectors(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The columns of ``vectors`` but ``vector``, with ``code`` (two hex digits per part) and ``error`` (squared distance)."""
    left = vectors.drop("vector").schema.add("code", "string").add("error", "long")
    return vectors.mapInArrow(_encoded(books), left)


def with_label_errors(coded: DataFrame, label: str = "label", salts: int = SALTS) -> DataFrame:
    """``label_error``: ``error`` summed over rows of the same label, nulls together; null if it is no long or any of them is null."""
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    sums = coded.groupBy(F.col(label).alias("_label")).agg(total.alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("code", "error", *coded.columns[:1]), F.lit(salts)).cast("int"))
    same = (rows["_salt"] == sums["_salt"]) & rows[label].eqNullSafe(sums["_label"])
    return rows.join(sums, same, "left").drop("_label", "_salt")


def compress_vectors(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every vector that takes part."""
    usable = usable_vectors(rows, vector).select(F.col(ROW)[vec_id].alias("vec_id"), F.col(ROW)[label].alias("label"), "vector")
    vectors = stage_table(usable, "codes-vectors")
    books = train_codebooks(vectors, parts, entries, rounds)
    if not books:
        return (
            vectors.drop("vector")
            .withColumn("code", F.lit(None).cast("string"))
            .withColumns({name: F.lit(None).cast("long") for name in ("error", "label_error")})
            .withColumn("codebooks_sha256", F.lit(codebook_digest([])))
        )
    coded = stage_table(encode_vectors(vectors, books), "codes-rows")
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(codebook_digest(books)))
