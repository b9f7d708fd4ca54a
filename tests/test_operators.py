"""Operators on small inline rows: the cases that the test tables do not show."""

import random
import re
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from groundtable.functions import text as T
from groundtable.operators import audit, chunking, evaluation, fusion, keyword, logs, publication, vectors
from groundtable.plans import all_queries
from groundtable.sources import corpus, pages


@pytest.mark.parametrize(
    "cos,bm25,overlap,coverage,passes",
    [
        (0.724, 21.95, 5, 1.0, True), (0.714, 13.61, 1, 1.0, True), (0.649, 5.30, 1, 0.8, True), (0.630, 10.19, 1, 1.0, True),
        (0.558, 7.60, 0, 0.67, False), (0.510, 14.04, 0, 0.75, False), (0.457, 7.84, 0, 0.50, False), (0.519, 5.33, 0, 0.50, False),
        (None, None, 0, 0.0, False), (None, 30.0, 3, 1.0, False),
    ],
)
def test_gate(spark, cos, bm25, overlap, coverage, passes):
    row = spark.createDataFrame([(1, cos, bm25, overlap, coverage)], "question_id int, best_cosine double, best_bm25 double, overlap long, coverage double")
    assert fusion.gate(row).first()["pass"] is passes


def test_anchoring_order(spark):
    keyword_leg = [(1, "keyword", 0, i + 1, c, 10.0 - i) for i, c in enumerate("zabcdefg")]
    semantic_leg = [(1, "semantic", 1, i + 1, c, 0.9 - i / 100) for i, c in enumerate("yabcdefg")]
    ranked = spark.createDataFrame(keyword_leg + semantic_leg, "question_id int, leg string, leg_place int, rank int, chunk_id string, score double")
    final = [r.chunk_id for r in fusion.anchored(fusion.fuse_ranks(ranked), 4).orderBy("final").collect()]
    assert final == ["a", "y", "z", "b"]


def test_tokenize_and_terms(spark):
    df = spark.createDataFrame([("How do I use gamepad1.left_stick_y on REV-45-2470?",), ("what is not a servo",), ("",)], "q string")
    rows = df.select(T.tokenize(F.col("q")).alias("t"), T.content_terms(F.col("q")).alias("c"), T.cache_terms(F.col("q")).alias("k"), T.search_terms(F.col("q")).alias("s")).collect()
    assert rows[0].t == ["how", "do", "use", "gamepad1.left_stick_y", "gamepad1", "left_stick_y", "on", "rev-45-2470"]
    assert rows[1].c == ["servo"] and rows[1].k == ["not", "servo"] and rows[2].s is None


def test_heading_paths_and_merge(spark):
    levels = [(1, "A"), (2, "B"), (3, "C"), (2, "D"), (4, "E"), (1, "F"), (3, "G")]
    df = spark.createDataFrame([(1, i, l, t, "x") for i, (l, t) in enumerate(levels)], "doc_id int, ord int, level int, title string, body string")
    paths = [r.heading_path for r in chunking.heading_paths(df).orderBy("ord").collect()]
    assert paths == ["A", "A > B", "A > B > C", "A > D", "A > D > E", "F", "F > G"]
    sizes = [100, 50, 300, 10, 5000]
    bodies = spark.createDataFrame([(1, i, "y" * n) for i, n in enumerate(sizes)], "doc_id int, ord int, body string")
    assert [len(r.body) for r in chunking.merge_thin(bodies).orderBy("ord").collect()] == [454, 10, 5000]


def test_atoms_and_split(spark):
    fence = "```java\n\nint x;\n\n```"
    body = "one\n\ntwo\n" + fence + "\nthree"
    assert spark.range(1).select(chunking.atoms(F.lit(body)).alias("a")).first().a == ["one", "two", fence, "three"]
    long = "\n\n".join("p" * 1000 for _ in range(5))
    parts = spark.range(1).select(chunking.split_oversize(F.lit(long)).alias("a")).first().a
    assert [len(p) for p in parts] == [2002, 2002, 1000]
    assert spark.range(1).select(F.size(chunking.split_oversize(F.lit("q" * 5000))).alias("n")).first().n == 1


def test_titles_anchors_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(chunking.tidy_title(F.lit("Managing OpModes in Blocks Blocks"))) == "Managing OpModes in Blocks"
    assert one(chunking.tidy_title(F.lit("Blocks Reference Materials Blocks"))) == "Blocks Reference Materials"
    assert one(chunking.tidy_title(F.lit("Java to Java"))) == "Java to Java"
    assert one(chunking.rule_units(F.lit("intro\nR101 first\nmore\nR102 second"))) == ["intro", "R101 first\nmore", "R102 second"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Über uns", "Setup", "Setup", "123", "Setup"])], "doc_id int, ord int, title string")
    assert [r.anchor for r in chunking.allocate_anchors(df).orderBy("ord").collect()] == ["uber-uns", "setup", "id1", "id2", "id3"]


def admit_by_hand(rows):
    """L11 as a walk: (log_id, caller, ts, signed_in) in time order to {log_id: (admitted, scope)}."""
    state, out = {}, {}
    for log_id, caller, ts, signed_in in sorted(rows, key=lambda r: (r[2], r[0])):
        minute, day = (caller, ts.strftime("%Y%m%d%H%M")), (caller, ts.strftime("%Y%m%d"))
        scope = "minute" if state.get(minute, 0) >= 10 else "day" if state.get(day, 0) >= (60 if signed_in else 25) else None
        out[log_id] = (scope is None, scope)
        for key in (minute, day) if scope is None else ():
            state[key] = state.get(key, 0) + 1
    return out


def crowded_requests():
    rng = random.Random(4)
    start = datetime(2024, 1, 1, 23, 40)
    return [(i, c := rng.randint(1, 4), start + timedelta(seconds=rng.randint(0, 2400) // 7 * 3, microseconds=rng.choice([0, 5])), c % 2 == 0) for i in range(600)]


REQUESTS = "log_id long, caller long, ts timestamp, signed_in boolean"


def test_admission_counts_only_admitted(spark):
    rows = crowded_requests()
    want = admit_by_hand(rows)
    got = {r.log_id: (r.admitted, r.scope) for r in logs.admission(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert got == want and {s for _, s in want.values()} == {None, "minute", "day"}


def test_pool_counts_allowed_calls_only(spark):
    """Beyond the day's ceiling a call takes nothing from its minute; the report counts admitted work and has the pool."""
    start = datetime(2024, 1, 1, 12, 0)
    rows = [(i, 7, start + timedelta(seconds=20 * i), True) for i in range(8)]  # three calls a minute
    log = spark.createDataFrame(rows, "log_id long, caller long, ts timestamp, llm_called boolean")
    params = logs.LogParams(daily_calls=4, calls_per_minute=4, spare_calls=3, per_day=5)
    got = [(r.log_id, r.allowed, r.spent_in_minute, r.may_escalate) for r in logs.daily_ceiling(log, params).orderBy("log_id").collect()]
    assert got == [(0, True, 1, True), (1, True, 2, True), (2, True, 3, False), (3, True, 1, True), (4, False, 1, False), (5, False, 1, False), (6, False, 0, False), (7, False, 0, False)]
    asked = log.withColumn("signed_in", F.lit(False))
    report = logs.usage_report(logs.admission(asked, params), spark.createDataFrame([(7, False)], "caller long, signed_in boolean"), logs.daily_ceiling(log, params), params)
    assert sorted(((r.caller or 0, r.used, r.limit, r.remaining) for r in report.collect())) == [(0, 4, 4, 0), (7, 5, 5, 0)]


def test_delta_and_rollback_round_trip(spark):
    schema = "chunk_id string, source_id string, text string"
    before = spark.createDataFrame([("a:1", "a", "x"), ("a:2", "a", "y"), ("b:1", "b", None)], schema)
    after = spark.createDataFrame([("a:1", "a", "x2"), ("b:1", "b", ""), ("c:1", "c", "n")], schema)
    columns = ["chunk_id", "source_id", "text"]
    forward, back = publication.delta(before, after, columns), publication.delta(after, before, columns)
    assert {r.chunk_id: r.change for r in forward.collect()} == {"a:1": "changed", "a:2": "removed", "b:1": "changed", "c:1": "added"}
    there = publication.apply_delta(before, after, forward)
    again = publication.apply_delta(there, before, back)
    assert again.exceptAll(before).isEmpty() and before.exceptAll(again).isEmpty()


def test_corpus_delta_sees_every_column(spark):
    """Each published column alone makes a row changed, in both tables; forward and rollback restore both."""
    kinds = {"can_excerpt": True, "char_len": 3, "ordinal": 1, "part": 1, "part_count": 2, "priority": 5}
    row = lambda fields, key, **other: {c: kinds.get(c, f"{c} of {key}") for c in fields} | {fields[0]: key, "updated_at": "old"} | other
    chunks = [row(publication.CHUNK_FIELDS, f"c{i}") for i in range(len(publication.CHUNK_FIELDS) + 2)]
    sources = [row(publication.SOURCE_FIELDS, f"s{i}") for i in range(len(publication.SOURCE_FIELDS) + 1)]
    spoil = lambda v: (not v) if isinstance(v, bool) else v + 1 if isinstance(v, int) else None
    new_chunks = [c | {f: spoil(c[f])} for c, f in zip(chunks[1:], publication.CHUNK_FIELDS[1:])] + [chunks[0] | {"updated_at": "new"}, row(publication.CHUNK_FIELDS, "added")]
    new_sources = [c | {f: spoil(c[f])} for c, f in zip(sources[1:], publication.SOURCE_FIELDS[1:])] + [sources[0] | {"updated_at": "new"}]
    schema = lambda fields: ", ".join(f"{c} {'boolean' if c == 'can_excerpt' else 'int' if c in kinds else 'string'}" for c in [*fields, "updated_at"])
    frame = lambda rows, fields: spark.createDataFrame([tuple(r[c] for c in [*fields, "updated_at"]) for r in rows], schema(fields))
    snapshot = lambda s, c: publication.Snapshot(frame(s, publication.SOURCE_FIELDS), frame(c, publication.CHUNK_FIELDS))
    before, after = snapshot(sources, chunks), snapshot(new_sources, new_chunks)
    forward, back = publication.corpus_delta(before, after), publication.corpus_delta(after, before)
    got = {(r.part, r.id): r.change for r in forward.collect()}
    fields = len(publication.CHUNK_FIELDS)
    assert got[("chunks", "c0")] == got[("sources", "s0")] == "unchanged" and got[("chunks", "added")] == "added"
    assert {got[("chunks", f"c{i}")] for i in range(1, fields)} == {"changed"} == {got[("sources", f"s{i}")] for i in range(1, len(publication.SOURCE_FIELDS))}
    assert got[("chunks", f"c{fields}")] == "removed" and got[("sources", f"s{len(publication.SOURCE_FIELDS)}")] == "removed"
    there = publication.apply_corpus_delta(before, after, forward)
    again = publication.apply_corpus_delta(there, before, back)
    for made, want in ((again.sources, before.sources), (again.chunks, before.chunks)):
        assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()
    lost = lambda **k: {r.source_id for r in publication.coverage_loss(before.chunks, before.chunks.limit(1), **k).collect()}
    assert None in lost() and "source_id of c5" in lost() and "source_id of c5" not in lost(allowed=("source_id of c5",))


def test_multi_query_sums_over_all_lists(spark):
    """A chunk that three phrasings find (0.04 each) beats one that a single phrasing finds higher."""
    rows = [(1, q, leg, place, rank, c, s) for q, leg, place, rank, c, s in (
        (10, "keyword", 0, 5, "often", 3.0), (11, "keyword", 0, 5, "often", 7.0), (12, "semantic", 1, 5, "often", 0.4),
        (10, "semantic", 1, 1, "once", 0.9), (11, "semantic", 1, 5, "tied", 0.3), (12, "keyword", 0, 5, "tied2", 1.0))]
    ranked = spark.createDataFrame(rows, "parent_id int, question_id int, leg string, leg_place int, rank int, chunk_id string, score double")
    got = [(r.chunk_id, round(r.rrf, 4), r.bm25, r.cosine, r.ranks) for r in fusion.multi_query(ranked).orderBy("place").collect()]
    assert got == [
        ("often", 0.12, 7.0, 0.4, {"keyword:10": 5, "keyword:11": 5, "semantic:12": 5}), ("once", 0.0476, None, 0.9, {"semantic:10": 1}),
        ("tied", 0.04, None, 0.3, {"semantic:11": 5}), ("tied2", 0.04, 1.0, None, {"keyword:12": 5}),
    ]
    asked = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 13)], "parent_id int, question_id int")
    stats = sorted(map(tuple, fusion.multi_query_stats(asked, ranked).collect()))
    assert stats == [(1, 3, 3, 3, 7.0, 0.9), (2, 1, 0, 0, None, None)]


def test_audit_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    grounded, beyond = audit.split_beyond(F.lit("===GROUNDED===\nFrom the page [1].\n===BEYOND===\nFrom experience."))
    assert (one(grounded), one(beyond)) == ("From the page [1].\n", "\nFrom experience.")
    assert one(audit.split_beyond(F.lit("no mark"))[1]) == ""
    drop = lambda t, more=False: one(audit.drop_deflection(F.lit(t), F.lit(more)))
    assert drop("The provided documentation does not state it.\nUse a belt.") == "Use a belt."
    assert drop("The docs don't say, but belts work. Use one.").startswith("The docs")
    assert drop("The index contains no figure.") == "The index contains no figure." and drop("The index contains no figure.", True) == ""
    assert drop("The robot does not move. Check it.").startswith("The robot")
    marks = lambda t: one(audit.strip_marks(F.lit(t)))
    assert marks("a [1] b\n```x\ny [1]\n``` [5]\nc [2, 3]. `z [4]`[4] arr[1] [1][2]") == "a  b\n```x\ny [1]\n``` [5]\nc . `z [4]` arr[1] [2]"
    assert marks("[7] first\n  ```\n[8]\n  ```\n[9]") == " first\n  ```\n[8]\n  ```\n"


def test_passages_and_symbols(spark):
    chunk = spark.createDataFrame([("c", "x" * 1500)], "chunk_id string, text string")
    assert [len(r.passage) for r in audit.passages(chunk).orderBy("start").collect()] == [900, 850, 200]
    code = 'Do this:\n```java\nimport a.B;\nclass Mine { Servo s; void go() { s.setPosition(1); s.fly(); Mine m; } } // Ghost.x()\n```'
    found = audit.unknown_symbols(spark.createDataFrame([(1, code)], "answer_id int, answer_md string"), spark.createDataFrame([("Servo",), ("setPosition",)], "name string"))
    assert [r.name for r in found.collect()] == ["fly"]


def test_structural_checks(spark):
    base = dict(status="done", error=None, complete=True, degraded=False, degrade_reason=None, refused=False, private=True, cached=False, answer="ok [1]", required=True, cited=[1])
    rows = [
        Row(case_id=1, **base),
        Row(case_id=2, **{**base, "error": "boom", "complete": False, "answer": " ", "cited": []}),
        Row(case_id=3, **{**base, "answer": "x][7] [7] `[8]`", "required": False}),
        Row(case_id=4, **{**base, "status": "not-run", "complete": False, "answer": None, "required": False, "cited": None}),
        Row(case_id=5, **{**base, "private": False, "degraded": True, "degrade_reason": "ceiling", "refused": True}),
        Row(case_id=6, **{**base, "cached": True, "degraded": True}),
    ]
    schema = "case_id int, status string, error string, complete boolean, degraded boolean, degrade_reason string, refused boolean, private boolean, cached boolean, answer string, required boolean, cited array<int>"
    got = {r.case_id: r for r in evaluation.structural_checks(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].status for i in (1, 2, 3, 4, 5)] == ["ready-for-review", "failed", "failed", "not-run", "failed"]
    assert len(got[2].failures) == 4 and got[3].failures == ["Citation [7] has no source record."]
    assert got[5].failures[0].startswith("Worker response") and got[5].failures[1] == "Source-only fallback (ceiling)." and len(got[5].failures) == 3
    assert got[6].failures[1] == "Source-only fallback (unknown)."


def test_page_sources(spark):
    board = '<script type="application/json">{"board":{"name":"b","config":{"isPublic":true}},"questions":[{"number":1,"questionId":"q1","status":"ANSWERED","title":"t","content":"c","answer":{"questionId":"q1","content":"a","modifiedAt":0}},{"number":2,"questionId":"q2","status":"OPEN"},{"number":3,"questionId":"q3","status":"ANSWERED","answer":{"questionId":"other"}}]}</script>'
    got = pages.board_answers(spark.createDataFrame([(1, board)], "page_id int, html string")).collect()
    assert [(r.number, r.answer) for r in got] == [(1, "a")]
    twice = spark.createDataFrame([(1, board.replace('"number":3,"questionId":"q3","status":"ANSWERED","answer":{"questionId":"other"}', '"number":1,"questionId":"q3","status":"ANSWERED","answer":{"questionId":"q3","content":"z","modifiedAt":0}'))], "page_id int, html string")
    assert pages.board_answers(twice).count() == 0 and [tuple(r) for r in pages.board_rejects(twice).collect()] == [(1, 1, 2)]
    page = '<title>x</title><p>before</p><h1 id="top">Head &amp; one</h1><p>a<b>b</b></p><div>c</div><nav><h2>menu</h2></nav><h2>Two</h2>tail<script>if (a<b) x</script>'
    found = pages.page_sections(spark.createDataFrame([(1, page), (2, "<p>no heading</p>")], "page_id int, html string")).collect()
    assert [tuple(r) for r in found] == [(1, 0, 1, "Head & one", "top", "a b\n\nc"), (1, 1, 2, "Two", "", "tail")]
    code = "/* Redistribution and use in any form */\npackage a;\n/*\n * Shows it.\n * Twice.\n */\nclass A {}\n" + "x" * 7000
    made = pages.code_chunks(spark.createDataFrame([("SensorIMU", code), ("Other", "class B {}")], "name string, text string")).orderBy("name").collect()
    assert made[1].description == "Shows it.\nTwice." and made[1].kind == "sensor" and made[0].kind == "basic" and made[0].description == ""
    assert "Redistribution" not in made[1].text and made[1].text.split("```java\n")[1].startswith("package a;") and len(made[1].text.split("```java\n")[1]) == 6000 + 4
    lines = pages.outline(spark.createDataFrame([(1, "- Top\n  - Sub\n    - Leaf\n- Next")], "doc_id int, text string"))
    assert [r.heading_path for r in chunking.heading_paths(lines).orderBy("ord").collect()] == ["Top", "Top > Sub", "Top > Sub > Leaf", "Next"]


def test_encoders_and_phrases(spark):
    chunks = spark.createDataFrame([("c1", "use gamepad1.left stick now"), ("c2", "left of gamepad1")], "chunk_id string, text string")
    encoded = vectors.encode_batches(chunks, lambda texts: [[float(len(t)), 1.0] for t in texts], "chunk_id", "text").collect()
    assert {r.chunk_id: r.vector for r in encoded} == {"c1": [27.0, 1.0], "c2": [16.0, 1.0]}
    v = {r.chunk_id: r.vector for r in vectors.hashed_vectors(chunks.unionByName(spark.createDataFrame([("c3", "!")], "chunk_id string, text string")), "chunk_id", "text", 8).collect()}
    assert len(v["c1"]) == 8 and abs(sum(x * x for x in v["c1"]) - 1) < 1e-12 and v["c3"] == [0.0] * 8
    full = chunks.withColumn("source_id", F.lit("s")).withColumn("page_title", F.lit("p")).withColumn("section_title", F.lit("s"))
    asked = spark.createDataFrame([(1, "gamepad1.left")], "question_id int, question string")
    posted, plain = keyword.postings(full, positions=True), keyword.postings(full)
    found = keyword.posted_phrases(posted, spark.createDataFrame([("gamepad1.left",), ("now-use",), ("use",), ("left_of-gamepad1",)], "phrase string"))
    assert sorted((r.phrase, r.chunk_id, r.tf) for r in found.collect()) == [("gamepad1.left", "c1", 1), ("left_of-gamepad1", "c2", 1), ("use", "c1", 1)]
    for index in (posted, plain):  # parts of the identifier are terms of their own
        dotted = {r.chunk_id: r.score for r in keyword.bm25(asked, index).collect()}
        assert set(dotted) == {"c1", "c2"} and dotted["c1"] > dotted["c2"]
    spaced = spark.createDataFrame([("d1", "the gamepad1 left stick"), ("d2", "gamepad1 is left"), ("d3", "x")], "chunk_id string, text string")
    spaced = spaced.selectExpr("*", "'s' AS source_id", "'p' AS page_title", "'s' AS section_title")
    hyphen = spark.createDataFrame([(1, "gamepad1-left")], "question_id int, question string")
    assert [r.chunk_id for r in keyword.bm25(hyphen, keyword.postings(spaced, positions=True)).collect()] == ["d1"]
    assert keyword.bm25(hyphen, keyword.postings(spaced)).count() == 0
    other = spark.createDataFrame([(1, "t")], "question_id int, source_id string")
    assert keyword.bm25(asked, posted, sources=other).count() == 0


def test_approximate_search_recall(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(1500)]
    table = spark.createDataFrame(rows, "id long, raw array<double>").select("id", vectors.unit(F.col("raw")).alias("vector"))
    asked = table.where("id % 100 = 0")
    exact = {(r.query_id, r.id) for r in vectors.cosine_top(asked, table, 10, block_bytes=1024).collect()}
    found = {(r.query_id, r.id) for r in vectors.approximate_top(asked, table, 10).collect()}
    assert len(exact) == len(found) == 150 and len(exact & found) >= 0.9 * len(exact)
    unit = {r.id: r.vector for r in table.collect()}
    for q in range(0, 1500, 100):
        order = sorted(unit, key=lambda i: (-round(sum(a * b for a, b in zip(unit[q], unit[i])), 9), i))[:10]
        assert {i for query, i in exact if query == q} == set(order)


def test_search_reads_probed_lists_only(spark, tmp_path):
    """Every list that no query probes is made unreadable; the search still gives the same rows."""
    rng = random.Random(6)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    table = spark.createDataFrame(rows, "id string, raw array<double>").select("id", vectors.unit(F.col("raw")).alias("vector"))
    path = str(tmp_path)
    vectors.store_lists(table, path, lists=10)
    asked = table.where("id IN ('v7', 'v8')")
    found = lambda: sorted(map(tuple, vectors.search_lists(asked, path, 5, probes=2).collect()))
    before = found()
    centres = {r.list: r.centre for r in spark.read.parquet(f"{path}/centres").collect()}
    probed = set()
    for r in asked.collect():
        probed |= set(sorted(centres, key=lambda i: -sum(a * b for a, b in zip(centres[i], r.vector)))[:2])
    assert len(before) == 10 and 0 < len(probed) < 10
    spoilt = [f for i in set(centres) - probed for f in (tmp_path / "lists" / f"list={i}").glob("*.parquet")]
    for file in spoilt:
        file.write_bytes(b"spoilt")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert len(spoilt) >= 6 and found() == before
    with pytest.raises(Exception):
        vectors.search_lists(asked, path, 5, probes=10).collect()


def test_best_of_many_queries_in_bounded_steps(spark, monkeypatch):
    """Scores made a few at a time, ids of text, and ties that go to the smaller id."""
    monkeypatch.setattr(vectors, "CELLS", 64)
    rng = random.Random(7)
    best, ids = vectors._Best(30, 3), np.array([f"v{i:03d}" for i in range(90)], dtype=object)
    scores = np.array([[rng.choice([0.1, 0.2, 0.3, 0.3 + 1e-12]) for _ in ids] for _ in range(30)])
    for first in range(0, 90, 40):
        best.offer(np.arange(30), scores[:, first : first + 40], ids[first : first + 40])
    for row in range(30):
        assert best.ids[row].tolist() == sorted(ids, key=lambda v: (-round(scores[row][int(v[1:])], 9), v))[:3]
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(60)], "id long, vector array<double>")
    found = vectors.cosine_top(rows, rows, 3, block_bytes=160).collect()
    assert len(found) == 180 and all(r.id == (2 * r["rank"] - 1 if r.query_id % 2 else 2 * r["rank"] - 2) for r in found)


def test_stems(spark):
    """Known pairs of the public suffix-stripping algorithm."""
    pairs = dict(
        caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", sing="sing", conflated="conflat", troubled="troubl", sized="size",
        hopping="hop", falling="fall", hissing="hiss", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", rational="ration", valenci="valenc",
        digitizer="digit", radicalli="radic", vietnamization="vietnam", operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", formaliti="formal", sensibiliti="sensibl",
        triplicate="triplic", formative="form", formalize="formal", electrical="electr", hopeful="hope", goodness="good", revival="reviv", allowance="allow", airliner="airlin", adjustable="adjust",
        replacement="replac", adjustment="adjust", dependent="depend", adoption="adopt", communism="commun", activate="activ", effective="effect", rate="rate", cease="ceas", controll="control", roll="roll",
    )
    words = spark.createDataFrame([(w,) for w in [*pairs, "café", "rev-45", "ab"]], "term string")
    got = {r.term: r.stem for r in keyword.vocabulary(words).collect()}
    assert {w: got[w] for w in pairs} == pairs and got["café"] == "cafe" and got["rev-45"] == "rev-45"


def test_questions_lose_marks_and_compatibility_forms(spark):
    texts = ["Ａ ﬁne Ünïcode ½", "plain", "ŝ ǆ"]
    plain = lambda t: re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))).strip()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in df.select(T.normalize_question(F.col("t")).alias("k")).collect()] == [plain(t) for t in texts]


def test_flags(spark):
    rows = [("Should I use a belt?", 0), ("what is the motor", 0), ("what is a belt", 4), ("show me a sample opmode", 0), ("Hi there", 0), ("howdy!", 0), ("does meepmeep work", 0), ("is R201 legal", 0), ("x " * 91, 0)]
    df = spark.createDataFrame(rows, "t string, n int")
    manual = F.array(F.lit("Competition Manual"))
    got = df.select(T.needs_depth(F.col("t"), F.col("n"), T.code_request(F.col("t"))).alias("deep"), T.is_greeting(F.col("t")).alias("hi"), T.unindexed_library(F.col("t")).alias("lib"), T.regulatory_question(F.col("t"), F.array(F.lit("x")), manual).alias("reg")).collect()
    assert [r.deep for r in got[:4]] == [True, False, True, True] and got[8].deep
    assert [i for i, r in enumerate(got) if r.hi] == [5] and [i for i, r in enumerate(got) if r.lib] == [6] and [i for i, r in enumerate(got) if r.reg] == [7]


def test_missing_version(spark):
    cases = {
        "why does the Follower of pedro pathing fail": "Pedro Pathing", "pedro 2 Follower fails": None, "road runner code": "Road Runner", "roadrunner upgrade version 1.0": None,
        "how can I find the ftclib version to import": None, "ftclib import": "FTCLib", "com.pedropathing:ftc:2.0 import": None, "pedro is fun": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.select("t", T.missing_version(F.col("t")).alias("v")).collect()} == cases


def test_manual_sections(spark):
    text = "front\n3.1  Contents ........ 7\n3.1  Team   Rules\n   R101 be fair " + "a" * 210 + "\n\n  RE14 more\n10.2 Next One\nshort\n"
    found = chunking.manual_sections(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [(r.number, r.title) for r in found.collect()] == [("3.1", "Team Rules")]
    chunk = chunking.manual_chunks(found).first()
    assert chunk.heading_path == "Competition Manual > 3.1 Team Rules > R101, RE14" and chunk.doc_path == "manual/3.1"


def test_anchors_pass_over_natural_ids(spark):
    rows = [(1, i, t, l) for i, (t, l) in enumerate([("A", None), ("A", None), ("id1", None), ("A", "own"), ("", None), ("id3", None)])]
    df = spark.createDataFrame(rows, "doc_id int, ord int, title string, label string")
    assert [r.anchor for r in chunking.allocate_anchors(df).orderBy("ord").collect()] == ["a", "id1", "id2", "own", "id3", "id4"]
    rng, docs = random.Random(6), []
    for doc in range(40):  # against an allocator that goes through the headings one by one
        docs += [(doc, i, rng.choice(["A", "B!", "id1", "id2", "ID 3", "id7", "", "Again"]), rng.choice([None, None, "My Label", "again", "id5", "??"])) for i in range(rng.randint(1, 25))]
    want, state = {}, {}
    for doc, i, title, label in docs:
        used, serial = state.setdefault(doc, (set(), [0]))
        plain = lambda t: re.sub("^[0-9]+-*", "", re.sub("[^a-z0-9]+", "-", (t or "").lower()).strip("-"))
        anchor = next((c for c in (plain(label), plain(title)) if c and c not in used), None)
        while anchor is None:
            serial[0] += 1
            anchor = f"id{serial[0]}" if f"id{serial[0]}" not in used else None
        used.add(anchor)
        want[doc, i] = anchor
    df = spark.createDataFrame(docs, "doc_id int, ord int, title string, label string")
    assert {(r.doc_id, r.ord): r.anchor for r in chunking.allocate_anchors(df).collect()} == want


def test_passages_are_found_whatever_their_words(spark):
    questions = spark.createDataFrame([(1, "one"), (2, "two words"), (3, "cut in the mid"), (4, "not there at all"), (5, "a.b c-d e_f")], "question_id long, question string")
    chunks = spark.createDataFrame([("a", "stone two words"), ("b", "xcut in the middle"), ("c", "see a.b c-d e_f.")], "chunk_id string, text string")
    got = {tuple(r) for r in evaluation.passage_truth(questions, chunks, block=1).collect()}
    assert got == {(1, "a"), (2, "a"), (3, "b"), (5, "c")}


def test_sinks(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "source_id string, chunk_id string, text string")
    pages.write_chunks(df([("a", "a:1", "x"), ("b", "b:1", "y")]), f"{tmp_path}/c")
    pages.write_chunks(df([("a", "a:2", "z")]), f"{tmp_path}/c")
    assert {(r.source_id, r.chunk_id) for r in spark.read.json(f"{tmp_path}/c").collect()} == {("a", "a:2"), ("b", "b:1")}
    one = pages.stage_publication(df([("a", "1", "x"), ("b", "2", None)]), df([]), f"{tmp_path}/p").collect()
    two = pages.stage_publication(df([("b", "2", None), ("a", "1", "x")]).repartition(2), df([]), f"{tmp_path}/q").collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in two} and {(r.artefact, r.rows) for r in one} == {("forward", 2), ("rollback", 0)}


def pack_lines(pieces, joint, target):
    out, buf, size = [], [], 0
    for p in pieces:
        if size and size + len(p) > target:
            out.append(joint.join(buf))
            buf, size = [], 0
        buf.append(p)
        size += len(p) + len(joint)
    return out + [joint.join(buf)] if buf else out


def test_long_rule_units_are_repacked_by_lines(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    plain = "\n".join("x" * (i * 37 % 900) for i in range(1, 40))
    by_code = "intro\n" + "\n".join(f"R{i} " + "a" * 1700 + "\n" + "b" * 1700 + "\n" + "c" * 900 * (i % 2) for i in range(101, 104)) + "\nR105 short\nR106 " + "d" * 5000
    for text, units in (("\n" + plain, ["\n" + plain]), (by_code, re.split(r"\n(?=[A-Z]{1,2}\d{2,3}\s)", by_code))):
        expected = [p for u in units for p in ([u] if len(u) <= 3600 else pack_lines(u.split("\n"), "\n", 2600))]
        got = one(chunking.rule_units(F.lit(text)))
        assert got == expected and len(got) > len(units) and "\n".join(got) == text
        assert all(len(u) <= 3600 for u in got if "\n" in u)
        assert one(chunking.rule_parts(F.lit(text))) == pack_lines(expected, "\n\n", 2600)


def test_learning_query(spark):
    schema = "question string, prior array<string>, title string, error string, code string"
    names = "DcMotorEx Servo hardwareMap setPower setDirection runOpMode OpMode LinearOpMode IMU VisionPortal Follower Telemetry DcMotor".split()
    rows = [("why does it stop", ["a" * 300, "b" * 300], "Motors", "e" * 300, "Servo x; " + " ".join(names)), ("one two three four five six seven eight nine", ["p"], None, "", None)]
    columns = [F.col(c.split()[0]) for c in schema.split(", ")]
    got = [r.q for r in spark.createDataFrame(rows, schema).select(T.learning_query(*columns).alias("q")).collect()]
    first = ["Servo", "DcMotorEx", *names[2:12]]
    assert got == [" — ".join(["why does it stop", "a" * 300 + " " + "b" * 99, "Motors", "e" * 240, *first]), rows[1][0]]


def split_by_hand(body):
    """C5 by brute force: lines one by one, fences closed or not at the end of the text."""
    if len(body) <= 3600:
        return [body]
    atoms, fence, buf = [], False, []

    def flush():
        if "\n".join(buf).strip():
            atoms.append("\n".join(buf).strip())
        buf.clear()

    for line in body.split("\n"):
        if line.startswith("```"):
            if not fence:
                flush()
            buf.append(line)
            if fence:
                flush()
            fence = not fence
        elif not fence and not line.strip():
            flush()
        else:
            buf.append(line)
    flush()
    out, part, size = [], [], 0
    for a in atoms:
        if size and size + len(a) + 2 > 2400:
            out.append("\n\n".join(part))
            part, size = [], 0
        part.append(a)
        size += len(a) + 2
    return out + ["\n\n".join(part)] if part else out


def test_split_and_render_leave_nothing_out(spark, tmp_path):
    fence = "```java\nint a;\n\nint b;\n" + "\n".join("c" * 90 for _ in range(40)) + "\n```"
    texts = {
        1: "short text " * 10,
        2: "\n".join("line %d " % i + "w" * (i * 91 % 700) for i in range(40)),
        3: "\n".join(["before " * 50, fence, "after " * 90, "more " * 300]),
        4: "x" * 5000,
        5: "few words",
    }
    spark.createDataFrame([(i, t, "src1") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = all_queries()[0]
    got = {i: [] for i in texts}
    for r in queries["C5_split_oversize"](spark, str(tmp_path)).orderBy("doc_id", "part").collect():
        got[r.doc_id].append(r.chars)
    assert got == {i: [len(p) for p in split_by_hand(t.replace("\n", "\n\n"))] for i, t in texts.items()}

    chunks = queries["C8_rendered_chunks"](spark, str(tmp_path)).orderBy("doc_id", "ordinal").collect()
    for i, text in texts.items():
        units, expected, inside = [], [], False
        for n, line in enumerate(text.split("\n")):
            if n % 16 == 0 and not inside:
                units.append([])
            units[-1].append(line)
            inside ^= line.startswith("```")
        for body in map("\n\n".join, units):
            if len(re.sub(r"\s+", " ", body).strip()) >= 80:
                pieces = split_by_hand(body)
                expected += [(n + 1 if len(pieces) > 1 else 0, len(pieces), p) for n, p in enumerate(pieces)]
        found = [r for r in chunks if r.doc_id == i]
        assert [(r.part, r.part_count, r.text.split("\n\n", 1)[1]) for r in found] == expected
        assert [r.ordinal for r in found] == list(range(len(expected)))
        assert all((f" (part {r.part} of {r.part_count})" in r.text.split("\n\n")[0]) is (r.part > 0) for r in found)
    assert {r.doc_id for r in chunks if r.part_count > 1} == {2, 3}


def test_source_adapters(spark):
    adapters = corpus.SourceAdapters()
    with pytest.raises(ValueError):
        adapters.load(spark, "")
    load = lambda session, path: session.createDataFrame([(path, "t", "x"), ("b", "t", None)], "doc_path string, page_title string, text string")
    adapters.add("one")(load)
    adapters.add("two")(load)
    with pytest.raises(ValueError):
        adapters.add("one")(load)
    assert [r.source_id for r in adapters.load(spark, "p").collect()] == ["one", "two"]
    assert [r.doc_path for r in adapters.load(spark, "p", ["two"]).collect()] == ["p"]
