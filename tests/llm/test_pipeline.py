"""The corpus pipeline, stage by stage on the smallest tables, against brute force on each stage's input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from groundtable.plans.shared import spill

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(spill(stage(spark, out[-1], SF), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out[-1].columns == columns
    return [df.collect() for df in out]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing",
    ]


def test_toxicity_keeps_clean_documents(spark, tables):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in tables[1]}
    clean = [i for i, t in toxic.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_exact_dedup(tables):
    first = {}
    for r in sorted(tables[1], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in tables[2]) == sorted(first.values())


def test_near_duplicates(tables):
    sets = {}
    for r in tables[2]:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r.doc_id for r in tables[3]) == sorted(i for i in sets if root[i] == i)


def test_mixing(tables):
    copies = Counter(r.doc_id for r in tables[4])
    given = {r.doc_id: r for r in tables[3]}
    assert set(copies) <= set(given) and max(copies.values()) <= 3
    size = {i: len(words(r.text)) for i, r in given.items()}
    sources = sorted({r.source for r in given.values()})
    total = {s: sum(size[i] for i, r in given.items() if r.source == s) for s in sources}
    target, free, left = {}, dict(zip(sources, [5, 2, 1] * len(sources))), sum(total.values())
    while free:
        level = left / sum(free.values())
        full = [s for s, w in free.items() if level * w > 3 * total[s]]
        if not full:
            target |= {s: level * w for s, w in free.items()}
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
            del free[s]
    for s in sources:
        taken = sum(copies[i] * size[i] for i, r in given.items() if r.source == s)
        assert abs(taken - target[s]) <= max(size[i] for i, r in given.items() if r.source == s)


def test_packing(tables):
    copies = Counter(r.doc_id for r in tables[4])
    tokens, whole = Counter(), {}
    fill = Counter()
    for r in tables[5]:
        tokens[r.doc_id] += r.length
        whole[r.doc_id] = r.doc_tokens
        fill[r.sequence_id] += r.length
    assert all(tokens[i] == n * whole[i] for i, n in copies.items()) and max(fill.values()) <= 1024


def test_awkward_rows_at_every_stage(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing names, ties and an empty table."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long), (None, long), (3, long + " tail"), (None, "some text of its own here"), (None, "some text of its own here"), (None, "another one, quite different"), (5, None)]
    rows += [(6, ""), (7, "first text under seven"), (7, "second text under seven, unlike it"), (8, "twice the same row of words"), (8, "twice the same row of words"), (None, None)]
    schema = "doc_id long, text string, source string, mix_copies int, mix_copy int, row_key int, id_again int, kept int, digest int, component_id int, copies int, id int, n int"
    df = spark.createDataFrame([(i, t, "s", *range(10)) for i, t in rows], schema)
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def texts(table):
        return sorted(((r.doc_id, r.text) for r in table.collect()), key=str)

    stages = dict(corpus_pipeline.STAGES)
    docs = spill(stages["toxicity"](spark, df, str(tmp_path)), "stage")
    assert texts(docs) == sorted(rows, key=str)
    docs = spill(stages["exact dedup"](spark, docs, ""), "stage")
    want = [(1, long), (3, long + " tail"), (None, "some text of its own here"), (None, "another one, quite different"), (5, None), (7, rows[9][1]), (7, rows[10][1]), (8, rows[11][1])]
    assert texts(docs) == sorted(want, key=str)
    docs = spill(stages["n-gram Jaccard join"](spark, docs, ""), "stage")
    want.remove((3, long + " tail"))
    assert texts(docs) == sorted(want, key=str)
    docs = spill(stages["mixing sources to target weights"](spark, docs, ""), "stage")
    assert texts(docs) == sorted(want, key=str)  # one source: its target is its size
    pieces = stages["packing"](spark, docs, "").collect()
    assert sorted({str(r.doc_id) for r in pieces}) == ["1", "5", "7", "8", "None"] and sum(r.start == 0 for r in pieces) == len(want)
    nothing = df.where("false")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, nothing, str(tmp_path))
        assert made.count() == 0 and (name == "packing" or made.columns == df.columns)
