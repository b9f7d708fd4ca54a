"""Streams over more than one batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_operators import REQUESTS, admit_by_hand, crowded_requests

from groundtable.operators import audit, evaluation, keyword
from groundtable.sources import corpus
from groundtable.streaming import log_streams as streams
from groundtable.streaming.answer_split import AnswerSplitter, split_stream


def test_corpus_updates_replace_and_withdraw(spark, tmp_path):
    schema = "doc_id long, text string, source string, version long"
    first = [(1, "alpha beta", "src1", 1), (2, "gamma delta", "src1", 1), (3, "same text", "src2", 1), (4, "to withdraw", "src2", 1), (5, "moves away", "src1", 1)]
    second = [(1, "older", "src1", 2), (1, "alpha omega", "src1", 4), (1, "oldest", "src1", 3), (3, "same text", "src2", 2), (4, None, "src2", 2), (5, "moves away", "src2", 2), (6, "new page", "src1", 1)]
    final = [(1, "alpha omega", "src1", 4), (2, "gamma delta", "src1", 1), (3, "same text", "src2", 1), (5, "moves away", "src2", 2), (6, "new page", "src1", 1)]
    path, dirty = str(tmp_path), []
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/pages")
        streams.corpus_updates(spark.readStream.schema(schema).parquet(f"{path}/pages"), path, corpus.chunks, keyword.postings, version="version")
        dirty.append({r.chunk_id for r in spark.read.parquet(f"{path}/dirty").where(f"batch = {n}").collect()})

    whole = corpus.chunks(spark.createDataFrame(final, schema))
    for kind, expected in (("chunks", whole), ("postings", keyword.postings(whole))):
        got = streams.current(spark, path, kind).select(*expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    ids = {r.doc_id: r.chunk_id for r in whole.collect()}
    assert len(dirty[0]) == 5 and dirty[1] == {ids[1], ids[5], ids[6]}


def in_batches(spark, rows, schema, path):
    """Rows as a stream of two batches, the earlier half first."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_admission_stream_keeps_its_counts(spark, tmp_path):
    rows = crowded_requests()
    stream = in_batches(spark, rows, REQUESTS, f"{tmp_path}/in")
    got = {r.log_id: r.admitted for r in streams.drain(streams.admission_stream(stream), "t2").collect()}
    assert got == {i: ok for i, (ok, _) in admit_by_hand(rows).items()}


def test_cache_stream_forgets_after_its_days(spark, tmp_path):
    start = datetime(2024, 1, 1)
    asked = [(0, "a", 0), (1, "a", 1), (2, "b", 2), (3, "a", 29), (4, "a", 31), (5, "b", 33), (6, "a", 60), (7, "a", 62)]
    stream = in_batches(spark, [(i, q, start + timedelta(days=d)) for i, q, d in asked], "log_id long, question string, ts timestamp", f"{tmp_path}/in")
    got = {r.log_id: r.hit for r in streams.drain(streams.cache_stream(stream), "t3").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}


MARKED = [
    "", "   ", "plain text without marks", "===GROUNDED===\nFrom the page [1].\n===BEYOND===\nFrom experience.", "==GROUNDED+==x==BEYOND==y", "  ===GROUNDED===\r\nA. B",
    "===BEYOND===only this", "no lead ===BEYOND===", "=GROUNDED= one sign is no mark =BEYOND= none", "a ===GROUNDED=== stray ====GROUNDED+=== b ===BEYOND=== c ===BEYOND=== d",
    "The provided documentation does not state it.\nUse a belt.", "===GROUNDED===\nThe docs lack this.===BEYOND===\nUse two.", "The index contains no figure.", "The docs don't say, but belts work. Use one.",
    "The docs do not say " + "x" * 400 + ". And more.", "The docs do not say " + "y" * 370 + ". And more.", "x" * 900 + ". The end", "The corpus lacks v1.2 notes. See the page.", "a == b and c === d ==GROUND ===BEYON== end=", "The docs lack it.   \n  ", "===GROUNDED===", "===GROUNDED===\r", "text ===BEYOND",
    "=======GROUNDED=======\n\n  Lead.\n=====BEYOND=====\n=BEYOND= rest", "==GROUNDED==\n==GROUNDED==\nTwice ==BEYOND==", "=GROUNDED=\nOf. ==BEYOND======BEYOND===", "==BEYOND==GROUNDED==", "a ==GROUNDED==BEYOND== b",
]


def test_answers_split_alike_however_cut(spark):
    """A6 on whole texts and on pieces of every size, and on cuts at each place."""
    texts = spark.createDataFrame(list(enumerate(MARKED)), "i int, t string")
    grounded, beyond = audit.split_beyond(F.col("t"))
    whole = {r.i: (r.g, r.b) for r in texts.select("i", grounded.alias("g"), beyond.alias("b")).collect()}

    def joined(pieces):
        splitter, out = AnswerSplitter(), []
        for piece in pieces:
            out += splitter.push(piece)
            splitter = AnswerSplitter(*splitter.state())
        out += splitter.push("", True)
        return tuple("".join(t for part, t in out if part == name) for name in ("grounded", "beyond"))

    for i, text in enumerate(MARKED):
        assert joined([text]) == whole[i], text
        for size in range(1, 40):
            assert joined([text[at : at + size] for at in range(0, len(text), size)]) == whole[i], (size, text)
        for at in range(min(len(text), 120)):
            assert joined([text[:at], text[at:]]) == whole[i], (at, text)
    assert whole[3] == ("From the page [1].\n", "\nFrom experience.") and whole[11] == ("", "\nUse two.")


def test_split_stream_over_batches(spark, tmp_path):
    """Frames of a response come in several batches; one response never ends and lapses."""
    start, rows = datetime(2024, 1, 1), []
    for i, text in enumerate(MARKED[:12]):
        pieces = [text[at : at + 9] for at in range(0, len(text), 9)]
        rows += [(i, seq, "token", piece, start + timedelta(seconds=seq)) for seq, piece in enumerate(pieces)]
        rows += [] if i == 3 else [(i, len(pieces), "done", None, start + timedelta(seconds=len(pieces)))]
    rows.sort(key=lambda r: (r[4], r[0]))
    late = [(99, 0, "token", "later", start + timedelta(hours=2)), (99, 1, "done", None, start + timedelta(hours=2))]
    schema = "response_id long, seq long, event string, data string, ts timestamp"
    for part in (rows[:20], rows[20:], late, [(100, 0, "done", None, start + timedelta(hours=5))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {}
    for r in sorted(streams.drain(split_stream(stream), "split").collect(), key=lambda r: r.seq):
        got.setdefault(r.response_id, {"grounded": "", "beyond": ""})[r.part] += r.text
    splitter = lambda text: AnswerSplitter().push(text, True)
    for i, text in enumerate(MARKED[:12]):
        want = {"grounded": "", "beyond": ""} | dict(splitter(text))
        assert got.get(i, {"grounded": "", "beyond": ""}) == want, text
    assert got[99]["grounded"] == "later"


FRAMES = [
    (1, 0, "meta", '{"citations":[{"n":3}],"refused":true,"cached":false}'), (1, 1, "token", '{"t":"a "}'), (1, 2, "token", '{"t":5}'), (1, 3, "beyond", '{"t":"out"}'), (1, 4, "evidence", '{"x":1}'),
    (1, 5, "meta", '{"citations":"none","privateContext":false,"tutor":{"s":1}}'), (1, 6, "token", '{"t":"b\u00e9"}'), (1, 7, "token", "null"), (1, 8, "token", "broken {"), (1, 9, "note", "[]"), (1, 10, "done", "{}"),
    (2, 0, "degrade", '{"reason":"","answerMd":3}'), (2, 1, "degrade", '{"reason":"busy","answerMd":"S"}'), (2, 2, "error", "{}"), (2, 3, "evidence", '{"x":2}'), (2, 4, "evidence", '{"x":3}'),
    (3, 0, "degrade", '{"answerMd":3}'), (3, 1, "done", "0"), (3, 2, "meta", '{"citations":[1,{"n":2}],"excerpts":[],"refused":"true","cached":1,"tutor":null}'),
]


def test_frames_assemble_alike_in_batches_and_at_once(spark, tmp_path):
    """E5 over all frames, T6 over batches of every third frame; unfinished responses lapse."""
    start = datetime(2024, 1, 1)
    schema = "response_id long, seq long, event string, data string, ts timestamp"
    rows = [(*f, start + timedelta(seconds=f[1])) for f in FRAMES]
    by_seq = sorted(rows, key=lambda r: r[1])
    late = [[(9, 0, "done", "{}", start + timedelta(hours=h))] for h in (2, 4)]
    for part in (by_seq[:5], by_seq[5:12], by_seq[12:], *late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = {r.response_id: r for r in streams.drain(streams.frame_assembly(stream), "t6").collect()}
    whole = {r.response_id: r for r in evaluation.assemble_frames(spark.createDataFrame(rows, schema)).collect()}
    assert {i: live[i] for i in (1, 2, 3)} == whole
    one, two, three = whole[1], whole[2], whole[3]
    assert (one.answer, one.beyond, one.citations, one.evidence, one.tutor) == ("a bé", "out", [], ['{"x":1}'], '{"s":1}')
    assert (one.complete, one.refused, one.private_context, one.cached, one.degraded, one.degrade_reason) == (True, False, False, None, False, None)
    assert one.events == ["meta", "token", "token", "beyond", "evidence", "meta", "token", "note", "done"]
    assert (two.degraded, two.degrade_reason, two.fallback_answer, two.error, two.complete, two.evidence) == (True, "busy", "S", "stream-error", False, ['{"x":2}', '{"x":3}'])
    assert (three.degrade_reason, three.fallback_answer, three.complete, three.citations, three.refused, three.cached, three.tutor) == ("unknown", "", False, ["1", '{"n":2}'], False, None, None)
    checks = {r.case_id: r.failures for r in evaluation.structural_checks(evaluation.recorded_responses(evaluation.assemble_frames(spark.createDataFrame(rows, schema)))).collect()}
    assert "stream-error" in checks[2] and "Source-only fallback (busy)." in checks[2] and "Required citations are absent." not in checks[3]
