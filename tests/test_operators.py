"""Rules that the table-driven comparison does not reach."""

from __future__ import annotations

import datetime
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from hitgrain.catalog import reports
from hitgrain.functions import events as E
from hitgrain.functions import lines as L
from hitgrain.operators import comments as K
from hitgrain.operators import coverage as C
from hitgrain.operators import history as H
from hitgrain.operators import messages as M
from hitgrain.operators import orchestration as O
from hitgrain.operators import scope as S
from hitgrain.operators import settings as T
from hitgrain.operators import uploads as U
from hitgrain.plans import reports as R
from hitgrain.sources.refs import ref_version, stored_refs, upsert_refs

LINES = (
    "project_id string, commit_id string, file_name string, line_number int, state string, contains_method boolean,"
    "contains_branch boolean, contains_statement boolean, total_branches bigint, covered_branches bigint"
)
DIFF = "project_id string, commit_id string, file_name string, diff_index int, line_number int"


def blocks_model(lines, diff):
    """Blocks by walking the lines of one file in order."""
    found, start, end = [], None, None
    for line in sorted(lines):
        number, state, method, branch = line
        if start is not None:
            known = number in diff and end[0] in diff
            in_row = known and diff.index(number) - diff.index(end[0]) == number - end[0]
            if method or state == "covered" or not in_row:
                found.append((start[2], start[0], end[0]))
                start = None
        if start is None and not branch and state != "covered":
            start = line
        end = line if start is not None else None
    if start is not None:
        found.append((start[2], start[0], end[0]))
    return found


def test_missing_coverage_blocks_random(spark):
    rng = random.Random(3)
    rows, diff_rows, expected = [], [], []
    for f in range(400):
        name = f"f{f}"
        numbers = sorted(rng.sample(range(1, 15), rng.randint(1, 10)))
        diff = sorted(rng.sample(range(1, 15), rng.randint(0, 14)))
        lines = [
            (n, rng.choice(["covered", "uncovered", "uncovered", "partial"]), rng.random() < 0.15, rng.random() < 0.25)
            for n in numbers
        ]
        rows += [("p", "c", name, n, s, m, b, not b, 0, 0) for n, s, m, b in lines]
        diff_rows += [("p", "c", name, i, n) for i, n in enumerate(diff)]
        expected += [(name, *block) for block in blocks_model(lines, diff)]
    lines, diff = spark.createDataFrame(rows, LINES), spark.createDataFrame(diff_rows, DIFF)
    got = K.missing_coverage_blocks(lines, diff)
    keys = ["project_id", "commit_id", "file_name", "line_number"]
    with_index = K.missing_coverage_blocks(lines.join(diff, keys, "left"))
    assert sorted(map(tuple, with_index.collect())) == sorted(map(tuple, got.collect()))
    assert sorted((r.file_name, r.starts_on_method, r.start_line, r.end_line) for r in got.collect()) == sorted(expected)


def unnested(spark, rows):
    """(upload, line, type, hits, branch hits) of one file."""
    schema = (
        "upload_id string, line_number int, type string, hits bigint, branch_hits array<bigint>"
    )
    df = spark.createDataFrame(rows, schema)
    return df.select(
        F.lit("p").alias("project_id"), F.lit("c").alias("commit_id"), F.lit("f").alias("file_name"), "upload_id",
        "line_number", *L.flag_line_types(F.col("type")), "hits", "branch_hits",
    )


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("a", 1, "STATEMENT", 0, [])], ("uncovered", 0, 0)),
        ([("a", 1, "STATEMENT", 0, []), ("b", 1, "STATEMENT", 2, [])], ("covered", 0, 0)),
        ([("a", 1, "BRANCH", 2, [0, 1])], ("partial", 2, 1)),
        ([("a", 1, "BRANCH", 2, [0, 1]), ("b", 1, "BRANCH", 1, [1, 0])], ("covered", 2, 2)),
        ([("a", 1, "BRANCH", 0, [0, 0])], ("uncovered", 2, 0)),
        ([("a", 1, "BRANCH", 0, [0, 3])], ("partial", 2, 1)),
        ([("a", 1, "BRANCH", 1, [0, 0])], ("partial", 2, 0)),
        ([("a", 1, "STATEMENT", None, [])], ("covered", 0, 0)),
        ([("a", 1, "STATEMENT", 4, []), ("b", 1, "BRANCH", 0, [0, 0])], ("partial", 2, 1)),
    ],
)
def test_line_states(spark, rows, expected):
    row = C.line_coverage(unnested(spark, rows)).first()
    assert (row.state, row.total_branches, row.covered_branches) == expected


def test_metadata_edge_cases(spark):
    rows = [
        (1, [("lineHits", "")]),
        (2, [("lineHits", "7"), ("lineHits", "9")]),
        (3, []),
        (4, [("branchHits", '{"0":1}')]),
        (5, [("branchHits", "[1,0,2]")]),
    ]
    df = spark.createDataFrame(rows, "id int, metadata array<struct<key:string,value:string>>")
    got = df.select("id", L.extract_line_hits(F.col("metadata")), L.extract_branch_hits(F.col("metadata"))).orderBy("id")
    assert [tuple(r) for r in got.collect()] == [(1, 0, []), (2, 7, []), (3, None, []), (4, None, []), (5, None, [1, 0, 2])]


def test_rounding(spark):
    df = spark.createDataFrame([(1, 32), (2, 3), (0, 5), (1, 160)], "k bigint, n bigint")
    assert [r[0] for r in df.select(L.percentage_2dp(F.col("k"), F.col("n"))).collect()] == [3.13, 66.67, 0.0, 0.63]
    values = spark.createDataFrame([(-0.334,), (0.125,), (-0.001,), (0.0,)], "d double")
    assert [str(r[0]) for r in values.select(L.round_2dp(F.col("d"))).collect()] == ["-0.33", "0.13", "0.0", "0.0"]


UPLOADS = (
    "upload_id string, project_id string, commit_id string, tag string, ingest_time timestamp_ntz, total_lines bigint"
)
HISTORY = "project_id string, commit_id string, number int, merged boolean, ref string, parents array<string>"


def chained(rows):
    """Commits of one line: each has the one before it in its project as its parent."""
    last, out = {}, []
    for row in sorted(rows, key=lambda r: (r[0], r[2])):
        out.append((*row, [last[row[0]]] if row[0] in last else []))
        last[row[0]] = row[1]
    return out


def random_graph(rng, numbers):
    """{number: parents}: mostly lines, with branches, merges, several roots, parents that are missing, and old parents."""
    graph = {}
    for i, n in enumerate(numbers):
        before = numbers[:i]
        near = [m for m in before if m >= n - 40]
        count = rng.choice([0, 1, 1, 1, 1, 1, 2, 2, 3]) if before else 0
        graph[n] = [rng.choice(near or before) if rng.random() < 0.9 else rng.choice(before) for _ in range(count)]
    return graph


def walked(graph, number):
    """All ancestors, newest first."""
    found, waiting = set(), list(graph[number])
    while waiting:
        n = waiting.pop()
        if n not in found:
            found.add(n)
            waiting += graph[n]
    return sorted(found, reverse=True)


def graph_history(spark, graph, refs=None):
    rows = [
        ("p", f"c{n}", n, None if n % 3 else False, (refs or {}).get(n), [f"c{m}" for m in parents] + (["gone"] if n % 7 == 0 else []))
        for n, parents in graph.items()
    ]
    return spark.createDataFrame(rows, HISTORY)


def upload(number, commit, tag, lines=1):
    return (f"u{number}", "p", commit, tag, datetime.datetime(2024, 1, 1), lines)


def test_carryforward(spark):
    uploads = spark.createDataFrame(
        [upload(1, "head", "a"), upload(2, "c3", "b", 5), upload(3, "c3", "b", 6), upload(4, "c9", "b"),
         upload(5, "c900", "far"), upload(6, "c400", "near"), upload(7, "c2", "off")], UPLOADS,
    )
    line = [("p", "head", 2000, None, None)] + [("p", f"c{i}", 2000 - i, None, None) for i in range(1, 1001)]
    history = spark.createDataFrame(chained(line), HISTORY)
    heads = spark.createDataFrame([("p", "head")], "project_id string, commit_id string")
    rules = spark.createDataFrame([("p", None, True), ("p", "off", False)], "repository_id string, tag string, carryforward boolean")
    candidates = H.carryforward_candidates(heads, uploads, rules)
    assert sorted(r.tag for r in candidates.collect()) == ["b", "far", "near"]
    carried = H.carryforward_tags(candidates, history, uploads)
    assert sorted((r.tag, r.source_commit, r.successfully_uploaded_lines) for r in carried.collect()) == [
        ("b", "c3", 5),
        ("b", "c3", 6),
        ("far", "c900", 1),
        ("near", "c400", 1),
    ]
    limited = H.nearest_tag_commits(candidates, history, uploads, max_position=400)
    assert sorted((r.tag, r.position) for r in limited.collect()) == [("b", 3), ("near", 400)]
    nearest = H.nearest_tag_commits(candidates, history, uploads)
    scope = S.scope_uploads_or_carryforward(uploads, heads, nearest)
    assert sorted((r.commit_id, r.upload_id) for r in scope.collect()) == [("head", f"u{i}") for i in (1, 2, 3, 5, 6)]


@pytest.mark.parametrize("span", [1, 7, 40, 10_000])
def test_nearest_tags_random(spark, span):
    rng = random.Random(span)
    numbers = sorted(rng.sample(range(-20, 280), 120))
    graph = random_graph(rng, numbers)
    tags = {n: rng.sample("abcd", rng.choice([0, 0, 0, 1, 2])) for n in numbers}
    uploads = spark.createDataFrame([upload(n, f"c{n}", t) for n in numbers for t in tags[n]], UPLOADS)
    lacking = [("p", f"c{n}", t) for n in numbers for t in "abcd" if t not in tags[n]] + [("p", "unknown", "a")]
    candidates = spark.createDataFrame(lacking, "project_id string, commit_id string, tag string")
    expected = set()
    for _, commit, tag in lacking[:-1]:
        before = [m for m in walked(graph, int(commit[1:])) if tag in tags[m]]
        if before:
            expected.add((commit, tag, f"c{before[0]}", int(commit[1:]) - before[0]))
    got = H.nearest_tag_commits(candidates, graph_history(spark, graph), uploads, span=span).collect()
    assert sorted((r.commit_id, r.tag, r.source_commit, r.position) for r in got) == sorted(expected)


@pytest.mark.parametrize("span", [1, 9, 10_000])
def test_base_from_history_random(spark, span):
    rng = random.Random(span + 1)
    numbers = sorted(rng.sample(range(400), 150))
    graph, refs, ref = random_graph(rng, numbers), {}, None
    for n in numbers:
        ref = rng.choice([ref, ref, ref, ref, "x", "y", None])
        refs[n] = ref
    heads = {n: rng.choice(["x", "y", "z"]) for n in numbers}
    events = spark.createDataFrame(
        [("p", f"c{n}", heads[n], "main") for n in numbers], "project_id string, commit_id string, ref string, base_ref string"
    )
    expected = {}
    for n in numbers:
        other = [m for m in walked(graph, n) if refs[m] != heads[n]]
        if other:
            expected[f"c{n}"] = (f"c{other[0]}", refs[other[0]] or "main")
    got = H.base_commit_from_history(events, graph_history(spark, graph, refs), span=span).collect()
    assert {r.commit_id: (r.base_commit, r.base_ref) for r in got} == expected


@pytest.mark.parametrize("span", [1, 30, 10_000])
def test_ancestors_random(spark, span):
    rng = random.Random(span + 2)
    numbers = sorted(rng.sample(range(300), 100))
    graph = random_graph(rng, numbers)
    history = graph_history(spark, graph)
    heads = rng.sample(numbers, 30)
    asked = spark.createDataFrame([("p", f"c{n}") for n in heads] + [("q", "c1")], "project_id string, commit_id string")
    got = H.commit_ancestors(history, asked, span=span).collect()
    expected = [(f"c{n}", i, f"c{m}", m % 3 != 0) for n in heads for i, m in enumerate(walked(graph, n), 1)]
    assert sorted((r.head, r.position, r.ancestor, r.merged) for r in got) == sorted(expected)
    limited = H.commit_ancestors(history, asked, 3, span).collect()
    assert sorted((r.head, r.ancestor) for r in limited) == sorted((h, a) for h, i, a, _ in expected if i <= 3)
    used = {m for parents in graph.values() for m in parents}
    assert {r.commit_id for r in H.branch_tips(history).collect()} == {f"c{n}" for n in numbers if n not in used}


def test_tags_of_other_branches_are_not_carried(spark):
    """Of two branches from one commit, neither takes the other's tag until it is merged."""
    rows = [("root", 1, []), ("left", 2, ["root"]), ("right", 3, ["root"]), ("merge", 4, ["right", "left"])]
    history = spark.createDataFrame([("p", c, n, True, None, parents) for c, n, parents in rows], HISTORY)
    uploads = spark.createDataFrame([upload(1, "root", "unit"), upload(2, "left", "unit")], UPLOADS)
    candidates = spark.createDataFrame([("p", "right", "unit"), ("p", "merge", "unit")], "project_id string, commit_id string, tag string")
    got = H.nearest_tag_commits(candidates, history, uploads).collect()
    assert {r.commit_id: r.source_commit for r in got} == {"right": "root", "merge": "left"}
    assert H.nearest_tag_commits(candidates.limit(0), history.limit(0), uploads).count() == 0


def test_base_commit(spark):
    schema = (
        "project_id string, commit_id string, ref string, base_ref string, base_commit string, pull_request bigint,"
        "parent array<string>"
    )
    events = spark.createDataFrame(
        [
            ("p", "far", "feature", "main", "eb", 1, ["pa"]),
            ("q", "alone", "feature", "main", "eb", 1, ["pa"]),
            ("p", "parent", "feature", None, None, None, ["pa", "pb"]),
            ("p", "none", "feature", None, None, None, []),
        ],
        schema,
    )
    rows = [("p", "h0", 0, True, None), ("p", "far", 700, True, "feature"), ("q", "alone", 1, True, "feature")]
    rows += [("p", f"h{i}", i, True, "feature") for i in range(1, 700)]
    history = spark.createDataFrame(chained(rows), HISTORY)
    got = {r.commit_id: (r.source, r.base_commit, r.base_ref) for r in H.base_commit(events, history).collect()}
    assert got == {
        "far": ("history", "h0", "main"),
        "alone": ("event", "eb", "main"),
        "parent": ("parent", "pa", "feature"),
        "none": ("none", None, None),
    }
    limited = H.base_commit_from_history(events, history, max_position=520)
    assert limited.isEmpty()


def test_upload_summary_without_uploads(spark):
    uploads = spark.createDataFrame([upload(1, "c1", "a")], UPLOADS)
    asked = spark.createDataFrame([("p", "c1"), ("p", "nothing")], "project_id string, commit_id string")
    got = {r.commit_id: (r.upload_id, r.tag_name) for r in U.upload_summary(uploads, asked).collect()}
    assert got == {"c1": ("u1", "a"), "nothing": (None, None)}


EVENTS = (
    "repository_id string, commit_id string, identifier string, kind string, state string, event_time timestamp_ntz,"
    "event_id bigint"
)


def random_events(seed, n=600):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    for i in range(n):
        commit, job = rng.randint(0, 5), rng.randint(0, 3)
        kind = "INGESTION" if job == 0 else "JOB"
        state = rng.choice(["IN_PROGRESS", "IN_PROGRESS", "SUCCESS", "FAILURE"])
        yield ("r", f"c{commit}", f"{kind}-{commit}-{job}", kind, state, start + timedelta(seconds=i + rng.randint(-40, 40)), i)


def screen_model(events):
    states, verdicts = {}, {}
    for e in sorted(events, key=lambda e: e[6]):
        was = states.get(e[2])
        if was and e[5] < was[1]:
            verdicts[e[6]] = "late"
        elif was and was[0] != "IN_PROGRESS" and e[4] == "IN_PROGRESS":
            verdicts[e[6]] = "regression"
        else:
            verdicts[e[6]] = None
            states[e[2]] = (e[4], e[5])
    return verdicts, states


@pytest.mark.parametrize("span", [25, 1_000_000])
def test_event_screening(spark, span):
    events = list(random_events(span))
    verdicts, states = screen_model(events)
    df = spark.createDataFrame(events, EVENTS).withColumn("stored_time", F.col("event_time"))
    screened = O.screen_events(df, span)
    assert {r.event_id: r.dropped for r in screened.collect()} == verdicts
    recorded = O.recorded_events(df, span)
    assert {r.identifier: (r.state, r.event_time) for r in O.latest_states(recorded).collect()} == states
    folded = O.event_state_fold(O.event_state_changes(recorded, span)).collect()
    assert {r.identifier: r.state["state"] for r in folded} == {k: v[0] for k, v in states.items()}


def finalised_model(recorded, quiet):
    out = []
    for commit in sorted({e[1] for e in recorded}):
        rows = sorted((e for e in recorded if e[1] == commit), key=lambda e: e[6])
        states, previous, ingested = {}, None, None
        for i, e in enumerate(rows):
            states[e[2]] = e[4]
            ended = e[4] != "IN_PROGRESS"
            if e[3] == "INGESTION" and ended:
                ingested = e[7]
            triggers = ended if e[3] == "INGESTION" else e[4] == "SUCCESS"
            still = i + 1 == len(rows) or rows[i + 1][7] - e[7] >= quiet
            if triggers and still and "IN_PROGRESS" not in states.values():
                if previous is None or (ingested is not None and ingested > previous):
                    out.append((commit, e[5], e[7]))
                previous = e[7]
    return out


def test_newer_event_by_stored_time(spark):
    """What arrived last counts, not what happened last; within a second the smallest identifier."""
    at = lambda s: datetime.datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("r", "c", "a", 100, 5.0), ("r", "c", "b", 10, 9.0), ("r", "d", "y", 1, 3.9), ("r", "d", "x", 50, 3.1), ("r", "e", "z", 1, 1.0)]
    states = spark.createDataFrame(
        [(r, c, i, at(happened), at(stored)) for r, c, i, happened, stored in rows],
        "repository_id string, commit_id string, identifier string, event_time timestamp_ntz, stored_time timestamp_ntz",
    )
    got = {(r.commit_id, r.identifier): r.newer for r in O.newer_event_recorded(states).collect()}
    assert got == {("c", "a"): True, ("c", "b"): False, ("d", "x"): False, ("d", "y"): True, ("e", "z"): False}


@pytest.mark.parametrize("span", [20, 86_400])
def test_uploads_finalised(spark, span):
    """Quiet periods and newer uploads go by arrival, whatever the events' own times say."""
    start = datetime.datetime(2024, 1, 1)
    events = [(*e, start + timedelta(seconds=3 * e[6])) for e in random_events(5)]
    verdicts, _ = screen_model(events)
    assert "late" in verdicts.values()
    quiet = timedelta(seconds=15)
    df = O.recorded_events(spark.createDataFrame(events, EVENTS + ", stored_time timestamp_ntz"))
    got = sorted((r.commit_id, r.event_time, r.stored_time) for r in O.uploads_finalised(df, quiet, span).collect())
    expected = finalised_model([e for e in events if verdicts[e[6]] is None], quiet)
    assert got == sorted(expected) and got


def test_state_change_diff_by_value_and_key(spark):
    df = spark.createDataFrame([({"a": "x", "b": "y"}, {"a": "y", "b": "y", "c": "z"})], "cur map<string,string>, new map<string,string>")
    by_value = df.select(E.state_change_diff(F.col("cur"), F.col("new"))).first()[0]
    by_key = df.select(E.state_change_diff(F.col("cur"), F.col("new"), strict_keys=True)).first()[0]
    assert by_value == {"c": "z"} and by_key == {"a": "y", "c": "z"}


def test_fold_replaces_same_version(spark):
    rows = [
        ("r", "c", "i", 1, {"state": "IN_PROGRESS", "commit": "1"}, 1),
        ("r", "c", "i", 2, {"state": "SUCCESS", "ref": "old"}, 2),
        ("r", "c", "i", 2, {"state": "FAILURE"}, 3),
    ]
    schema = "repository_id string, commit_id string, identifier string, version int, change map<string,string>, event_id int"
    row = O.event_state_fold(spark.createDataFrame(rows, schema)).first()
    assert (row.state, row.version) == ({"state": "FAILURE", "commit": "1"}, 2)


def test_messages_first_wins_ties(spark):
    rows = [("g", 1, [(5, "a"), (9, "b")]), ("g", 2, [(9, "c")]), ("h", 3, [(1, "d")]), (None, 4, [(99, "e")])]
    df = spark.createDataFrame(rows, "message_group string, seq bigint, messages array<struct<valid_until:bigint,payload:string>>")
    got = M.latest_message_per_group(df).collect()
    assert sorted((r.message_group, r.position, r.payload) for r in got) == [("g", 0, "a"), ("g", 1, "b"), ("h", 0, "d")]


def test_settings_validation(spark):
    rows = [
        ("line_comment.type", "hidden", True),
        ("line_comment.type", "loud", False),
        ("path_replacements", '[{"before":"a","after":null}]', True),
        ("path_replacements", '[{"after":"b"}]', False),
        ("tag_behaviour.default", '{"carryforward":false}', True),
        ("tag_behaviour.default", "{}", False),
        ("tag_behaviour.tags", "nonsense", False),
        ("other", "1", False),
    ]
    df = spark.createDataFrame(rows, "key string, value string, ok boolean")
    checked = df.select("key", "value", "ok", T.valid_setting(F.col("key"), F.col("value")).alias("valid")).collect()
    assert [(r.key, r.value) for r in checked if r.ok != r.valid] == []


REF_RESULTS = "repository_id string, ref string, coverage_percentage double, event_time bigint"


def ref_files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_ref_table_upserts(spark, tmp_path):
    """Random batches, some repeated, against a dictionary; only touched buckets get new files; old versions can be read."""
    rng, path, newest, seen = random.Random(4), str(tmp_path / "refs"), {}, []
    assert stored_refs(spark, path).count() == 0 and ref_version(spark, path) == 0
    batches = [[(rng.choice(["a", "b", None]), rng.choice(["main", "dev", "x", None]), float(rng.randint(0, 100)), 100 * i + j) for j in range(n)] for i, n in enumerate([30, 2, 0])]
    batches += [batches[0], [("a", "main", 1.0, -5)]]
    for number, batch in enumerate(batches, 1):
        assert upsert_refs(path, spark.createDataFrame(batch, REF_RESULTS), buckets=16) == number
        for repository, ref, percentage, at in batch:
            if at >= newest.get((repository, ref), (0, -(10**9)))[1]:
                newest[repository, ref] = (percentage, at)
        seen.append(dict(newest))
        got = stored_refs(spark, path).collect()
        assert {(r.repository_id, r.ref): (r.coverage_percentage, r.event_time) for r in got} == newest and len(got) == len(newest)
    old = stored_refs(spark, path, version=1).collect()
    assert {(r.repository_id, r.ref): (r.coverage_percentage, r.event_time) for r in old} == seen[0]
    last = [f for f in ref_files(tmp_path / "refs") if f.startswith("data/version=5")]
    assert len(last) == 1


def test_ref_table_survives_a_write_that_stopped(spark, tmp_path):
    path = str(tmp_path / "refs")
    upsert_refs(path, spark.createDataFrame([("a", "main", 1.0, 1)], REF_RESULTS), buckets=4)
    stray = spark.createDataFrame([("a", "main", 9.0, 9)], REF_RESULTS)
    for bucket in range(4):
        stray.write.parquet(f"{path}/data/version=2/bucket={bucket}")
    assert [r.coverage_percentage for r in stored_refs(spark, path).collect()] == [1.0]
    assert upsert_refs(path, spark.createDataFrame([("b", "main", 2.0, 2)], REF_RESULTS)) == 2
    assert sorted((r.repository_id, r.coverage_percentage) for r in stored_refs(spark, path).collect()) == [("a", 1.0), ("b", 2.0)]


def test_states_of_scope_and_own_uploads_come_from_one_pass(spark):
    chance = random.Random(3)
    pick = lambda *values: chance.choice(values)
    scope = [("p", c, f"u{n}", pick(c, "other")) for c in ("a", "b") for n in range(4)]
    lines = [
        (f"u{pick(0, 1, 2, 3)}", pick("f", "g", None), chance.randint(1, 12), pick("BRANCH", "METHOD", "STATEMENT", None),
         pick(None, 0, 0, 1), pick(None, [], [0], [0, 1], [0, None]))
        for _ in range(300)
    ]
    scope = spark.createDataFrame(scope, "project_id string, commit_id string, upload_id string, source_commit string")
    scope = scope.withColumn("ingest_date", F.lit("2024-01-01").cast("date"))
    lines = spark.createDataFrame(lines, "upload_id string, file_name string, line_number int, type string, hits bigint, branch_hits array<bigint>")
    keys = ["project_id", "commit_id", "file_name", "line_number"]
    found = R.scope_and_own_states(scope, lines)
    whole = C.line_coverage(C.join_upload_lines(scope, lines)).select(*keys, "state")
    assert sorted(map(repr, found.select(*keys, "state").collect())) == sorted(map(repr, whole.collect()))
    own = C.join_upload_lines(scope.filter("source_commit = commit_id"), lines)
    got = found.filter("own_state is not null").select(*keys, F.col("own_state").alias("state"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, C.line_coverage(own).select(*keys, "state").collect()))
    diff = whole.filter("line_number % 3 > 0").select(*keys, F.col("line_number").alias("diff_index"))
    got = R.own_diff_lines(found, diff).select(*keys, "diff_index", "state")
    assert got.count() and sorted(map(repr, got.collect())) == sorted(
        map(repr, S.diff_line_states(own, diff).select(*keys, "diff_index", "state").collect())
    )


def test_pull_request_summary_joins_the_lines_once(spark, monkeypatch):
    calls, join = [], C.join_upload_lines
    monkeypatch.setattr(C, "join_upload_lines", lambda *args: calls.append(1) or join(*args))
    assert reports.q_pull_request_summary(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1
