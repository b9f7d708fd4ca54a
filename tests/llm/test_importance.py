"""Importance sampling and prefix CRCs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from groundtable.llm import importance
from groundtable.llm.crc_prefix import PrefixCrc
from groundtable.llm.importance import ImportanceParams, importance_sample

SCHEMA = "doc_id long, text string, id long, n long, bucket long, score long, place long"


def test_prefix_crc():
    rng = np.random.RandomState(3)
    for size in (0, 1, 63, 64, 65, 640, 9_000):
        data = rng.randint(0, 256, size).astype(np.uint8)
        starts = rng.randint(0, size + 1, 300)
        ends = np.minimum(size, starts + rng.randint(0, 2_000, 300))
        assert PrefixCrc(data).spans(starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def _plain(docs, target, p):
    def features(text):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        grams = [" ".join(words[i : i + k]) for k in range(p.least, p.most + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % p.buckets for g in grams]

    read = [features(d[1]) for d in docs]
    s, t = Counter(b for _, f in read for b in f), Counter(b for text in target for b in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets)))) for b in range(p.buckets)]
    out = []
    for d, (words, found) in zip(docs, read):
        h = int(hashlib.sha256(f"{p.seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([d[0], len(found), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    some = sorted((r for r in out if r[2] >= p.least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for place, row in enumerate(some[: p.percent * len(some) // 100]):
        row[5] = place + 1
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "of", "Ab9", "é", "中文", "ÀB", "x", "naïve", "W" + str(rng.randint(0, 60))])
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) + rng.choice(["", ".", " \n"]) for _ in range(150)]
    texts += [None, "", "!!!", "one", "a-b_c`d{e", "x" * 3000, "tail word", ("long Text, " * 90_000) + "end"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1] + " more"), (5, texts[9] + " other")]
    docs += [(77, texts[77])] * 3
    return [(*d, -1, 2, 3, 4, 5) for d in docs]


@pytest.mark.parametrize("most, part", [(1, None), (3, 1 << 16)])
def test_importance(spark, rows, most, part, monkeypatch):
    if part:  # workers don't see the patched size, so the parts of a long text are compared with the whole here
        monkeypatch.setattr(importance, "_PART", part)
        data = np.frombuffer(rows[157][1].encode(), dtype=np.uint8)
        cut, whole = [], importance._features(data, np.array([0, len(data)]), 0, ImportanceParams(most=most))
        for piece, shared in importance._long_parts(data, most):
            cut.append(importance._features(piece, np.array([0, len(piece)]), shared, ImportanceParams(most=most)))
        assert len(cut) > 5
        assert Counter(np.concatenate([c[0] for c in cut]).tolist()) == Counter(whole[0].tolist())
        assert sum(len(c[2]) for c in cut) == len(whole[2])
    params = ImportanceParams(most=most, buckets=500, percent=30, least_words=10)
    target = ["the of the é", None, "naïve Ab9 w3 w4", ""]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = importance_sample(docs, spark.createDataFrame([(t,) for t in target], "text string"), params=params)
    assert Counter(map(tuple, got.collect())) == _plain(rows, target, params)


def test_importance_of_nothing(spark, rows):
    docs = spark.createDataFrame(rows[:30], SCHEMA)
    nothing = docs.where("false")
    assert importance_sample(nothing, docs).collect() == []
    drawn = importance_sample(docs, nothing).where("rank is not null").count()
    assert drawn == sum(len((r[1] or "").split()) >= 20 for r in rows[:30]) // 10
