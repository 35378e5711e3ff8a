"""Ancestors on a commit graph with branches and merges.

``history`` has one row per commit: ``project_id``, ``commit_id``, its ``number`` in the order of the project's commits
(unique in the project, every commit after its parents) and ``parents``, the identifiers of its parents.

A project's commits are cut by number into chunks. Within a chunk parents come before children, so one walk in order settles
it, up to the parents that lie in earlier chunks. What a chunk tells later ones is short: for each of its commits that is a
parent of a later chunk, what its chunk knows and which earlier commits that depends on. These few commits form a much smaller
graph, which is settled by pointer doubling in as many rounds as the logarithm of the number of chunks. A last walk
over each chunk, with the answers for its outer parents, gives the result.

Scale: a task holds one chunk, however long a project's history is. No head meets all its ancestors, but in ``ancestors_of``, whose
result is just that.

Defined results: a parent that is not in ``history``, or not older than its child, is passed over. Marks and wishes
for unknown commits are passed over too.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.session import stage_table

# How many neighbouring commits of a project share a chunk.
SPAN = 10_000
CHUNK = "_chunk"
# Per kind the two newest marks, each a commit's number, its name, and a label that tells it from others of its kind.
Marks = dict[object, list[tuple]]


def commit_edges(history: DataFrame, span: int = SPAN) -> DataFrame:
    """``project_id``, ``child`` and ``parent`` (numbers) with their chunks."""
    numbers = history.select("project_id", F.col("commit_id").alias("_parent"), F.col("number").cast("long").alias("parent"))
    edges = history.select("project_id", F.col("number").cast("long").alias("child"), F.explode("parents").alias("_parent"))
    edges = edges.join(numbers, ["project_id", "_parent"]).filter("parent < child").drop("_parent").distinct()
    return edges.withColumn(CHUNK, _chunk("child", span)).withColumn("_parent_chunk", _chunk("parent", span))


def _chunk(number: str, span: int):
    value = F.col(number).cast("long")
    return F.call_function("div", value - F.pmod(value, F.lit(span)), F.lit(span))


def joined_marks(*groups: Iterable[tuple]) -> list[tuple]:
    """The two newest marks with different labels."""
    best: list[tuple] = []
    for mark in sorted((m for group in groups for m in group), key=lambda m: m[0], reverse=True):
        if not best or (len(best) < 2 and mark[2] != best[0][2]):
            best.append(mark)
    return best


def _rows_of(pdf: pd.DataFrame, role: str, *columns: str) -> list[tuple]:
    own = pdf[pdf["role"] == role]
    return list(zip(*(own[c].tolist() for c in columns), strict=True))


class _Chunk:
    """The commits of one chunk, walked from old to new."""

    def __init__(self, pdf: pd.DataFrame):
        self.parents: dict[int, list[int]] = {}
        for child, parent in _rows_of(pdf, "edge", "number", "parent"):
            self.parents.setdefault(int(child), []).append(int(parent))
        self.marks: dict[int, Marks] = {}
        for number, commit, kind, label in _rows_of(pdf, "mark", "number", "commit_id", "kind", "label"):
            own = self.marks.setdefault(int(number), {})
            own[_none(kind)] = joined_marks(own.get(_none(kind), []), [(int(number), commit, _none(label))])
        self.first = int(pdf["_first"].iloc[0])

    def own_parents(self, number: int) -> list[int]:
        return [p for p in self.parents.get(number, ()) if p >= self.first]

    def outer_parents(self, number: int) -> list[int]:
        return [p for p in self.parents.get(number, ()) if p < self.first]

    def before(self, outer: dict[int, Marks]) -> dict[int, Marks]:
        """Newest marks among the ancestors of each commit, given those at or before outer parents."""
        known: dict[int, Marks] = {}
        for number in sorted(self.parents):
            sources = [outer.get(p, {}) for p in self.outer_parents(number)]
            sources += [self.at(p, known) for p in self.own_parents(number)]
            # One parent hands its marks on as they are.
            known[number] = sources[0] if len(sources) == 1 else _merged(sources)
        return known

    def at(self, number: int, known: dict[int, Marks]) -> Marks:
        """Newest marks at the commit or before it."""
        own, earlier = self.marks.get(number), known.get(number, {})
        return _merged([earlier, own]) if own else earlier

    def reached(self) -> tuple[list[int], dict[int, int]]:
        """The outer parents in order, and for each commit those that it depends on, as bits."""
        outer = sorted({p for n in self.parents for p in self.outer_parents(n)})
        place = {p: 1 << i for i, p in enumerate(outer)}
        bits: dict[int, int] = {}
        for number in sorted(self.parents):
            found = 0
            for p in self.parents[number]:
                found |= place[p] if p < self.first else bits.get(p, 0)
            bits[number] = found
        return outer, bits


def _none(value):
    return None if value is None or value != value else value


def _merged(sources: list[Marks]) -> Marks:
    out: Marks = {}
    for source in sources:
        for kind, marks in source.items():
            out[kind] = joined_marks(out[kind], marks) if kind in out else marks
    return out


def _bits(value: int) -> Iterable[int]:
    while value:
        low = value & -value
        yield low.bit_length() - 1
        value ^= low


def _role(df: DataFrame, name: str, span: int, number: str = "number", **columns: str) -> DataFrame:
    """Rows of one role in the shape that all inputs of a chunk share."""
    fields = {"parent": "bigint", "commit_id": "string", "kind": "string", "label": "string"}
    picked = [
        (F.col(columns[c]) if c in columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()
    ]
    chunk = _chunk(number, span)
    return df.select(
        "project_id",
        chunk.alias(CHUNK),
        (chunk * span).alias("_first"),
        F.lit(name).alias("role"),
        F.col(number).cast("long").alias("number"),
        *picked,
    )


def _exported(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each commit that later chunks name: its newest marks, and what it depends on in earlier chunks."""
    chunk = _Chunk(pdf)
    known, (outer, bits) = chunk.before({}), chunk.reached()
    project, out = pdf["project_id"].iloc[0], []
    for number in sorted({int(n) for (n,) in _rows_of(pdf, "export", "number")}):
        for kind, marks in chunk.at(number, known).items():
            out += [(project, number, None, kind, *mark) for mark in marks]
        out += [(project, number, outer[i], None, None, None, None) for i in _bits(bits.get(number, 0))]
    return pd.DataFrame(out, columns=["project_id", "node", "pointer", "kind", "number", "commit_id", "label"])


EXPORTED = "project_id string, node bigint, pointer bigint, kind string, number bigint, commit_id string, label string"


def _newest(marks: DataFrame) -> DataFrame:
    """The two newest marks with different labels of each (project, node, kind)."""
    keys = ["project_id", "node", "kind"]
    newest = marks.groupBy(*keys, "label").agg(F.max(F.struct("number", "commit_id")).alias("_m"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_m.number")))
    ranked = newest.withColumn("_place", place).filter("_place <= 2")
    return ranked.select(*keys, "_m.number", "_m.commit_id", "label")


def _settled(exported: DataFrame) -> DataFrame:
    """Marks at or before each exported commit, over all chunks: pointer doubling on the graph of exports."""
    pointers = stage_table(exported.filter("pointer is not null").select("project_id", "node", "pointer"), "ancestry-pointers")
    marks = stage_table(exported.filter("pointer is null").select("project_id", "node", "kind", "number", "commit_id", "label"), "ancestry-marks")
    while not pointers.isEmpty():
        there = marks.withColumnRenamed("node", "pointer")
        gained = pointers.join(there, ["project_id", "pointer"]).select(*marks.columns)
        marks = stage_table(_newest(marks.unionByName(gained)), "ancestry-marks")
        onward = pointers.select("project_id", F.col("node").alias("pointer"), F.col("pointer").alias("_next"))
        pointers = pointers.join(onward, ["project_id", "pointer"]).select("project_id", "node", F.col("_next").alias("pointer"))
        pointers = stage_table(pointers.distinct(), "ancestry-pointers")
    return marks


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    outer: dict[int, Marks] = {}
    for node, kind, number, commit, label in _rows_of(pdf, "outer", "number", "kind", "parent", "commit_id", "label"):
        own = outer.setdefault(int(node), {})
        own[_none(kind)] = joined_marks(own.get(_none(kind), []), [(int(number), commit, _none(label))])
    chunk = _Chunk(pdf)
    known = chunk.before(outer)
    project, out = pdf["project_id"].iloc[0], []
    for number, commit, kind in _rows_of(pdf, "want", "number", "commit_id", "kind"):
        marks = known.get(int(number), {}).get(_none(kind), [])
        if marks:
            first, second = (marks[i] if i < len(marks) else (None, None, None) for i in (0, 1))
            out.append((project, commit, number, _none(kind), *first, *second))
    columns = ["project_id", "commit_id", "number", "kind"]
    columns += [f"{which}_{field}" for which in ("first", "second") for field in ("number", "commit", "label")]
    return pd.DataFrame(out, columns=columns).astype({"second_number": "Int64"})


ANSWERED = (
    "project_id string, commit_id string, number bigint, kind string, first_number bigint, first_commit string, "
    "first_label string, second_number bigint, second_commit string, second_label string"
)


def nearest_marked(history: DataFrame, marks: DataFrame, wanted: DataFrame, span: int = SPAN) -> DataFrame:
    """The newest marked ancestor of each wanted commit, the commit itself excluded.

    ``marks`` has ``project_id``, ``commit_id``, ``kind`` and ``label``, ``wanted`` has ``project_id``, ``commit_id`` and ``kind``. One row per wanted
    (commit, kind) that has a marked ancestor: its ``number``, ``first_*`` (``number``, ``commit``, ``label`` of the newest) and
    ``second_*`` (the newest with another label than the first, or null).
    """
    edges = stage_table(commit_edges(history, span), "ancestry-edges")
    keys = ["project_id", "commit_id"]
    numbers = history.select(*keys, F.col("number").cast("long").alias("number"))
    marked = _role(marks.join(numbers, keys), "mark", span, commit_id="commit_id", kind="kind", label="label")
    wishes = _role(wanted.join(numbers, keys), "want", span, commit_id="commit_id", kind="kind")
    inside = stage_table(_role(edges, "edge", span, "child", parent="parent").unionByName(marked), "ancestry-rows")
    rows = inside.unionByName(wishes)
    crossing = edges.filter(F.col(CHUNK) != F.col("_parent_chunk"))
    if not crossing.isEmpty():
        exports = _role(crossing.select("project_id", "parent").distinct(), "export", span, "parent")
        exported = inside.unionByName(exports).groupBy("project_id", CHUNK).applyInPandas(_exported, EXPORTED)
        settled = _settled(stage_table(exported, "ancestry-exports"))
        # What a chunk's outer parents know goes to that chunk.
        ports = crossing.select("project_id", CHUNK, F.col("parent").alias("node")).distinct()
        outer = ports.join(settled, ["project_id", "node"]).select(
            "project_id",
            CHUNK,
            (F.col(CHUNK) * span).alias("_first"),
                F.lit("outer").alias("role"),
            F.col("node").alias("number"),
            F.col("number").alias("parent"),
            "commit_id",
            "kind",
            "label",
        )
        rows = rows.unionByName(outer)
    return rows.groupBy("project_id", CHUNK).applyInPandas(_answered, ANSWERED)


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each asked or exported commit: itself, its ancestors within the chunk, and the outer parents it depends on."""
    chunk = _Chunk(pdf)
    outer, bits = chunk.reached()
    places = sorted(chunk.parents.keys() | {p for n in chunk.parents for p in chunk.own_parents(n)})
    at = {n: i for i, n in enumerate(places)}
    within: dict[int, int] = {}
    for number in places:
        found = 0
        for p in chunk.own_parents(number):
            found |= within[p] | 1 << at[p]
        within[number] = found
    project, out = pdf["project_id"].iloc[0], []
    for number in sorted({int(n) for role in ("export", "want") for (n,) in _rows_of(pdf, role, "number")}):
        out.append((project, number, None, number))
        out += [(project, number, None, places[i]) for i in _bits(within.get(number, 0))]
        out += [(project, number, outer[i], None) for i in _bits(bits.get(number, 0))]
    return pd.DataFrame(out, columns=["project_id", "node", "pointer", "ancestor"]).astype({"pointer": "Int64", "ancestor": "Int64"})


def ancestors_of(history: DataFrame, heads: DataFrame, span: int = SPAN) -> DataFrame:
    """``project_id``, ``head`` and ``ancestor`` (numbers) of all ancestors of each of ``heads``, the head excluded."""
    edges = stage_table(commit_edges(history, span), "ancestry-edges")
    wanted = heads.select("project_id", "commit_id").join(history.select("project_id", "commit_id", "number"), ["project_id", "commit_id"])
    crossing = edges.filter(F.col(CHUNK) != F.col("_parent_chunk"))
    rows = (
        _role(edges, "edge", span, "child", parent="parent")
        .unionByName(_role(wanted, "want", span))
        .unionByName(_role(crossing.select("project_id", "parent").distinct(), "export", span, "parent"))
    )
    schema = "project_id string, node bigint, pointer bigint, ancestor bigint"
    found = stage_table(rows.groupBy("project_id", CHUNK).applyInPandas(_inside, schema), "ancestry-inside")
    pointers = found.filter("pointer is not null").select("project_id", "node", "pointer")
    # All exports that a node leads to, itself included: paths double in each round until no new pair comes.
    reach = stage_table(pointers, "ancestry-reach")
    size, grown = -1, reach.count()
    while grown > size:
        onward = reach.select("project_id", F.col("node").alias("pointer"), F.col("pointer").alias("_next"))
        longer = reach.join(onward, ["project_id", "pointer"]).select("project_id", "node", F.col("_next").alias("pointer"))
        reach = stage_table(reach.unionByName(longer).distinct(), "ancestry-reach")
        size, grown = grown, reach.count()
    asked = wanted.select("project_id", F.col("number").cast("long").alias("head"))
    nodes = asked.withColumn("node", F.col("head")).unionByName(
        asked.join(reach.withColumnRenamed("node", "head"), ["project_id", "head"]).select("project_id", "head", F.col("pointer").alias("node"))
    )
    inside = found.filter("ancestor is not null").select("project_id", "node", "ancestor")
    return nodes.join(inside, ["project_id", "node"]).select("project_id", "head", "ancestor").filter("ancestor < head").distinct()
