"""One small case for each finding of a review."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from groundtable.functions import text
from groundtable.llm import chunk_tokens
from groundtable.operators import audit, evaluation, keyword, publication, vectors
from groundtable.plans import audit_queries, retrieval_queries, stream_queries
from groundtable.streaming import log_streams as streams

SF = "/root/testdata/sf0.01"


def test_coverage_loss_leaves_no_source_out(spark):
    """Every source that lost is told, src1 and src4 too."""
    chunks = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL AND source IS NOT NULL")
    counts = chunks.groupBy("source").agg({"*": "count"}).collect()
    kept = {r[0]: r[1] for r in chunks.where("length(text) > 1000").groupBy("source").agg({"*": "count"}).collect()}
    expected = {source for source, n in counts if kept.get(source, 0) < 0.8 * n}
    assert {"src1", "src4"} <= expected
    assert expected == {r.source_id for r in __spark_entry__.queries()["P6_coverage_loss"](spark, SF).collect()} - {None}


def test_evidence_covers_every_cited_paragraph(spark):
    """An answer of thirteen cited paragraphs has evidence for all of them, unless a list of twelve is asked for."""
    answer = "\n\n".join(f"The intake motor number{i} stalls [1]" for i in range(13))
    answers = spark.createDataFrame([(1, answer)], "answer_id long, answer_md string")
    cited = spark.createDataFrame([(1, 1, "c", True)], "answer_id long, n int, chunk_id string, can_excerpt boolean")
    chunks = spark.createDataFrame([("c", "The intake motor stalls at low battery.")], "chunk_id string, text string")
    assert audit.evidence(answers, cited, chunks, most=None).count() == 13 and audit.evidence(answers, cited, chunks).count() == 12


def test_admission_stream_makes_few_groups(spark, tmp_path):
    """Two hundred callers of one day share a few groups, and each keeps its own counts over batches; a null caller is one of them."""
    start = datetime(2024, 1, 1)
    schema = "log_id long, caller long, ts timestamp, signed_in boolean"
    for batch in range(2):
        rows = [(batch * 100_000 + c * 100 + i, c or None, start + timedelta(minutes=batch, seconds=i), False) for c in range(200) for i in range(14)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = streams.admission_stream(stream, buckets=3)
    got = streams.drain(made, "t2-few").groupBy("caller").agg(F.count_if("admitted").alias("n"), F.count("*").alias("all")).collect()
    assert len(got) == 200 and {(r.n, r.all) for r in got} == {(20, 28)}
    assert "bucket" in made._jdf.queryExecution().analyzed().toString()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_searches_shuffle_neither_postings_nor_pairs(spark):
    """Stems, document frequencies and scores are made where a chunk is stored."""
    rows = [(f"c{i}", "s", "Motor mounts", "Mounting motors", f"motor motors mounted a.bc.def word{i}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, page_title string, section_title string, text string")
    index = keyword.chunk_index(chunks, words=True)
    assert "Exchange" not in plan(keyword.stemmed_postings(index))
    stems = {(r.term, r.field): r.tf for r in keyword.stemmed_postings(index).where("chunk_id = 'c3'").collect()}
    assert stems[("motor", "text")] == 2 and stems[("mount", "section_title")] == 1 and stems[("mount", "text")] == 1
    frequency = keyword.document_frequency(keyword.postings(chunks))
    assert plan(frequency).count("Exchange hashpartitioning") == 1
    assert {r.term: r.df for r in frequency.collect()}.items() >= {"motor": 40, "mounts": 40, "word7": 1, "a.bc.def": 40}.items()
    asked = spark.createDataFrame([(1, "mounted word7"), (2, "motors a.bc.def")], "question_id long, question string")
    whole, best = keyword.bm25(asked, index), keyword.bm25(asked, index, best=3)
    assert "Exchange" not in plan(whole) + plan(best) and whole.count() == 80
    top = {(r.question_id, r.chunk_id, r["rank"]) for r in keyword.top_candidates(whole, 3).collect()}
    assert top == {(r.question_id, r.chunk_id, r["rank"]) for r in keyword.top_candidates(best, 3).collect()} and (1, "c7", 1) in top


def test_phrases_and_passages_are_found_without_a_token_shuffle(spark):
    """Phrases come out of the index as they come out of its rows; words of passages are met where a chunk is read."""
    rows = [("c1", "s", "na na na", "x", "na na na b na"), ("c2", "s", "b", "na", "b na. Na-na"), ("c3", "s", "", "", "na")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, page_title string, section_title string, text string")
    phrases = spark.createDataFrame([("na-na",), ("b.na",), ("na-na-na",), ("na",), ("-",), ("b-x",)], "phrase string")
    index = keyword.chunk_index(chunks, words=True)
    found = keyword.posted_phrases(index, phrases)
    assert "hashpartitioning" not in plan(found)
    facts = lambda df: sorted((r.phrase, r.chunk_id, r.field, r.len, r.tf) for r in df.collect())
    assert facts(found) == facts(keyword.posted_phrases(keyword.postings(chunks, positions=True), phrases))
    assert ("na-na", "c1", "text", 7, 2) in facts(found) and ("na-na-na", "c1", "page_title", 7, 1) in facts(found)
    assert "Exchange" not in plan(evaluation._asked_words(chunks, ["na", "b"]))


def test_topic_words_are_tried_by_their_first_letter(spark):
    """The pattern finds what the plain alternatives find, in their order, and tries few of them at a place."""
    assert text._any_word(["ab", "cd", "a ?c"]) == "(?=[ac])(?<![a-z0-9_])(a(?:b| ?c)|c(?:d))"
    plain = "(?<![a-z0-9_])(" + "|".join(text.WEAK_WORDS) + ")"
    sample = "autopath armpit xarm partition, pathname axes-axis camera_cad 3plates plates subtract"
    assert re.findall(text._any_word(text.WEAK_WORDS), sample) == re.findall(plain, sample)
    rows = spark.createDataFrame([("one wheel", 0.3), ("one wheel", 0.1), ("wheel, gears", 0.1), ("none", 0.7), ("an FTC robot", None), ("none", None), ("hello", 0.9)], "t string, c double")
    assert [r.k for r in rows.select(text.topic_class(F.col("t"), F.col("c")).alias("k")).collect()] == ["ftc", "off", "ftc", "ftc", "ftc", "off", "meta"]


def test_index_is_made_by_tasks_that_do_not_grow(spark, monkeypatch):
    """A larger corpus gives more tasks, not larger ones, whatever the shuffle partitions."""
    monkeypatch.setattr(retrieval_queries, "CHUNKS_A_TASK", 50)
    monkeypatch.setattr(retrieval_queries, "_stored", {})
    index = retrieval_queries.stored_index(spark, SF)
    assert len(index.inputFiles()) == 20 and index.count() == retrieval_queries.corpus(spark, SF).count()


def test_candidates_below_the_kept_ones_are_not_sorted(monkeypatch):
    """Of later scores only those that may enter a list are ordered; ties on nine digits still go to the smaller id."""
    best, ids = vectors._Best(2, 2), np.array(["b", "c", "d"], dtype=object)
    best.offer(np.arange(2), np.array([[0.9, 0.8, 0.1], [0.9, 0.8, 0.7]]), ids)
    sorted_ids, plain = [], np.unique
    monkeypatch.setattr(vectors.np, "unique", lambda a, *x, **y: sorted_ids.append(a.shape) or plain(a, *x, **y))
    best.offer(np.arange(2), np.array([[0.7, 0.1, 0.2], [0.1, 0.2, -np.inf]]), np.array(["e", "f", "g"], dtype=object))
    assert not sorted_ids
    best.offer(np.arange(2), np.array([[0.8 - 2e-10, 0.1, 0.1], [0.1, 0.2, 0.3]]), np.array(["a", "f", "g"], dtype=object))
    assert sorted_ids == [(1, 3)] and best.ids.tolist() == [["b", "a"], ["b", "c"]]


def test_runs_are_taken_apart_without_a_loop_over_them(monkeypatch):
    """Only runs with signs are read one by one; terms, fields and counts are those of X1."""
    read, plain = [], keyword._read_run
    monkeypatch.setattr(keyword, "_read_run", lambda run: read.append(run) or plain(run))
    length, _, terms, fields, tf = keyword._index_texts(["Motor a", None, "motor motor caf\u00e9 x-y. ab.cdef.ghi \U0001f600ok"], ("terms", "fields", "tf"))
    assert sorted(read) == ["ab.cdef.ghi", "x-y."] and length.to_pylist() == [9]
    found = {(t, f): n for t, f, n in zip(terms[0].as_py(), fields[0].as_py(), tf[0].as_py())}
    assert found == {("motor", 0): 1, ("motor", 2): 2, ("caf", 2): 1, ("x-y", 2): 1, ("ab.cdef.ghi", 2): 1, ("cdef", 2): 1, ("ghi", 2): 1, ("ok", 2): 1}


def test_corpus_updates_store_postings_as_lists(spark, monkeypatch):
    """T7 writes a row of postings per chunk, which no task takes apart; as rows they are those of K1."""
    given = []
    monkeypatch.setattr(stream_queries.streams, "corpus_updates", lambda pages, path, chunk, post: given.append(post))
    monkeypatch.setattr(stream_queries.streams, "current", lambda spark, path, kind: spark.createDataFrame([("c", "h")], "chunk_id string, content_hash string"))
    stream_queries.t7(spark, "/root/testdata/sf0.001")
    chunks = retrieval_queries.corpus(spark, "/root/testdata/sf0.001")
    made = given[0](chunks)
    assert "Generate" not in plan(made) and "Exchange" not in plan(made) and made.count() == chunks.count()
    facts = lambda df: {(r.term, r.chunk_id, r.field, r.tf) for r in df.collect()}
    assert facts(keyword.entries(made, "fields", "tf")) == facts(keyword.postings(chunks))


def test_chunks_are_looked_up_once_a_batch():
    """op12: a batch's chunks are told apart before they are looked up; ids are those of the plain call, whatever the white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coder, plain, asked = chunk_tokens.ChunkTokens(vocabulary), Tokenizer.from_file(vocabulary), []

    class Counted(chunk_tokens._Known):
        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)

    coder._known = Counted(coder._tool, coder._letters)
    assert [len(ids) for ids in coder.encode(["the cat " * 500, "", "cat the"])] == [1000, 0, 2] and sorted(asked) == ["cat", "the"]
    odd = ["a\x1cb c\x85d", "x\u2003y\u3000z\xa0", " \t\x0b", "caf\xe9 NA\xcfVE, Q.", "\u65e5\u672c \u8a9e\u3002", "a\x00b \U0001f600 x", "word" * 40 + " end"]
    assert [ids.tolist() for ids in coder.encode(odd)] == [plain.encode(text, add_special_tokens=False).ids for text in odd]


def test_publish_decision_ranks_once(spark, monkeypatch):
    """Gate and routing read one pair of ranked lists."""
    made, plain = [], retrieval_queries.ranked
    for module in (retrieval_queries, audit_queries):
        monkeypatch.setattr(module, "ranked", lambda *a: made.append(1) or plain(*a), raising=False)
    audit_queries.e4(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_words_are_remembered_without_signs_and_cases():
    """op12: a word is encoded once however it is written; what may not be cut or made lower case still has the tokenizer's ids."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from groundtable.llm.chunk_tokens import ChunkTokens

    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = ChunkTokens(path), Tokenizer.from_file(path)
    texts = ["Reading&&& reading*** (READING) reading-Éreading é%% É; rÉAD"]
    assert [x.tolist() for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(own._known) - {"É", "rÉad"} == {"reading", "&&&", "***", "(", ")", "-", "Éreading", "éreading", "é", "%%", ";", "réad"}
    rng, signs = random.Random(7), [*"aBsTİéÉ×÷ſKΣσ中1.,!?&%-'\"()<|> \x1ć̱̇H", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "é", "ẞ", "’", "ﬁ"]
    for turn in range(40):
        texts = ["".join(rng.choice(signs if turn % 2 else signs[:-6]) for _ in range(rng.randint(0, 30))) for _ in range(50)]
        assert [x.tolist() for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_document_frequency_counts_where_chunks_are_read(spark, monkeypatch):
    """no posting leaves the task that reads a chunk; a term goes on once for many chunks, with the counts of the postings."""
    made = retrieval_queries.k3_df(spark, "/root/testdata/sf0.001")
    assert "Generate" not in plan(made) and plan(made).count("Exchange hashpartitioning") == 1
    facts = lambda df: {(r.term, r.df) for r in df.collect()}
    assert facts(made) == facts(keyword.document_frequency(keyword.postings(retrieval_queries.corpus(spark, "/root/testdata/sf0.001"))))
    rows = [("Motor mounts", None, "motor a.bc.def Motor"), (None, None, None), ("", "mounts", "x é a_b a_b -motor-"), ("a", "b", "c")] * 3
    odd = spark.createDataFrame([(f"c{i}", "s", *row) for i, row in enumerate(rows)], "chunk_id string, source_id string, page_title string, section_title string, text string")
    expected = {("motor", 6), ("mounts", 6), ("a.bc.def", 3), ("def", 3), ("a_b", 3)}
    monkeypatch.setattr(keyword, "_CHARS", 30)
    assert facts(keyword.document_frequency(odd.coalesce(1))) == facts(keyword.document_frequency(keyword.postings(odd))) == expected
    empty = odd.where("page_title = 'none'")
    assert facts(keyword.document_frequency(empty)) == set()


def test_chunk_violations_and_their_sql_state_one_rule(spark, tmp_path):
    """query and SQL agree on repeated ids, ids too long, numbers below zero, missing ids, blank texts and a text that has the spoiled hash."""
    rows = [(1, "one", "src1"), (1, "two", "src1"), (2, "three", "s" * 47 + "3"), (-1, "four", "src2"), (None, "five", "src0"), (22, "x", "src2"), (44, "y", "src2")]
    rows += [(28, "\n", "src2"), (29, "\n", "src2")]  # an odd one of this source has its text from the template
    rows += [(5 + 22 * i, text, "src0") for i, text in enumerate(["", *publication.BLANKS, publication.BLANKS, "\x85", "\u200b", "\x1c"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["P1_chunk_violations"](spark, str(tmp_path)).select("chunk_id", "problem").collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(tuple(r) for r in got) == sorted(duck.execute(__spark_entry__.oracle_sql()["P1_chunk_violations"]).fetchall())
    counts = {p: sum(r.problem == p for r in got) for p in ("duplicate id", "id shape", "ordinal", "hash", "empty text")}
    assert counts == {"duplicate id": 2, "id shape": 2, "ordinal": 2, "hash": 1, "empty text": 1 + 1 + len(publication.BLANKS) + 1}
