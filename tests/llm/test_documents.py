"""Document operators against brute force on a fixture of awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from groundtable.llm.byte_hash import FIELD_LOWER_CODES, IS_SPACE, word_hashes
from groundtable.llm.exact_dedup import Directory, exact_dedup
from groundtable.llm.jaccard_join import JaccardParams, jaccard_components
from groundtable.llm.language_id import LanguageParams, identify_languages, learn_languages
from groundtable.llm.mixing import mix_sources
from groundtable.llm.packing import PackingParams, pack_documents, plan_cuts
from groundtable.llm.repeat_removal import RepeatParams, remove_repeats
from groundtable.llm.run_index import _symbols, build, repeated_windows
from groundtable.llm.toxicity import FtrlParams, _features, score_toxicity, toxicity_score, train_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, body string, key string, rank int, copies int"


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(40)]
    base = texts[0].split()
    near = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in (3, len(base) - 2)]
    passage = " ".join(word() for _ in range(80))
    texts += near + [texts[1], texts[1].replace(" ", " \n\t"), texts[2].upper()]
    texts += [None, "", "   ", "one", "one two", "One TWO", "ünï çödé 中文", "!!!", passage + " x", "y " + passage, " ".join(word() for _ in range(30_000)), "ab " * 400, "see <|endoftext|> here", "1234567abc " * 40_000]
    langs, sources = ["en", "de", None], ["a", "b", None, "é"]
    out = [(i, t, langs[i % 3], sources[i % 4], 7, -1, "clash", "k", 3, 9) for i, t in enumerate(texts)]
    return out + [out[4]]  # one row twice


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_exact_dedup(docs, nothing, rows):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = sorted(tuple(r) for r in exact_dedup(docs, capacity_bytes=4096, most_depth=6).collect())
    want = sorted(
        (r[0], min(g := groups[norm(r[1])]), len(g), r[0] == min(g), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows
    )
    assert got == want
    assert exact_dedup(nothing).count() == 0


def test_directory_doubles_and_splits():
    weights = {0: 50, 1: 50, 2: 1, 15: 400}
    d = Directory(60, 4).load(weights)
    assert d.depth == 4 and len(d.slots) == 16
    owners = [o for _, _, o in d.rows(weights, 3)]
    assert owners == sorted(owners) and max(owners) < 3


def _sets(text, k):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_jaccard_components(docs, rows, words, num):
    sets = {r[0]: _sets(r[1], words) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, params=JaccardParams(words=words, num=num)).collect()}
    assert found == {(i, len(s), find(i)) for i, s in sets.items()}


def test_jaccard_awkward_ids_and_words(spark):
    """Words that collide modulo 2**64, rows that repeat an id or have none, and a very long text."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, morse + " x y"), (2, morse.translate(str.maketrans("ab", "ba")) + " x y"), (3, "p q r s"), (4, "p q r s"), (4, "other words than those"), (4, "p q r s")]
    rows += [(None, "p q r s"), (None, "nothing like it"), (None, None), (5, long), (6, long + " end"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rows", "2 AS band", "3 AS component")
    found = [tuple(r) for r in jaccard_components(df, params=JaccardParams(words=3, num=90)).select("doc_id", "n_shingles", "component_id").collect()]
    fours = {r for r in found if r[0] == 4}
    assert len(fours) == 1 and [r[0] for r in found].count(4) == 3 and fours <= {(4, 2, 3), (4, 2, 4)}
    assert sorted(r for r in found if r[0] not in (4, None)) == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (5, 399_998, 5), (6, 399_999, 5), (7, 0, 7), (7, 0, 7)]
    assert sorted((r for r in found if r[0] is None), key=str) == sorted([(None, 2, 3), (None, 1, None), (None, 0, None)], key=str)


def test_word_hashes_in_parts():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", " ", "c" * rng.randint(1, 150)]) for _ in range(rng.randint(0, 60))).encode()
        data = np.frombuffer(text, dtype=np.uint8)
        whole = word_hashes(data, np.array([0, len(data)]), ~IS_SPACE, FIELD_LOWER_CODES)[0]
        assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
        assert word_hashes(data, np.array([0, len(data)]), ~IS_SPACE, FIELD_LOWER_CODES, 16)[0].tolist() == whole.tolist()


def test_word_hashes_of_several_rows():
    """Rows that together exceed the step keep their own words."""
    rows = [b"ab cd " * n + b"x" * n for n in (5, 300, 1, 0, 40)]
    data, offsets = np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum([0] + [len(r) for r in rows])
    hashes, owner = word_hashes(data, offsets, ~IS_SPACE, FIELD_LOWER_CODES, 64)
    assert np.bincount(owner, minlength=5).tolist() == [len(r.split()) for r in rows]
    for i, row in enumerate(rows):
        alone = word_hashes(np.frombuffer(row, dtype=np.uint8), np.array([0, len(row)]), ~IS_SPACE, FIELD_LOWER_CODES, 64)[0]
        assert alone.tolist() == hashes[owner == i].tolist()


def test_toxicity_in_large_batches(spark):
    """Batches of several megabytes: toxic rows are told from clean ones, and every score is that of the row alone."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=500) + (["vile", "nasty"] if i % 5 == 0 else []))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = train_toxicity(df, labels)
    together = {r.doc_id: r.s for r in df.select("doc_id", toxicity_score(df, model).alias("s")).collect()}
    apart = {r.doc_id: r.s for r in df.where("doc_id < 40").repartition(40).select("doc_id", toxicity_score(df, model).alias("s")).collect()}
    assert all(abs(together[i] - s) < 1e-12 for i, s in apart.items())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((together[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)


def test_jaccard_empty(nothing):
    assert jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("window,gram,swarm", [(200, 48, 1 << 15), (30, 8, 1 << 15), (30, 8, 3)])
def test_remove_repeats(docs, nothing, rows, window, gram, swarm):
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + window] for _, b in bodies for i in range(len(b) - window + 1))
    want = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    params = RepeatParams(window=window, gram=gram, index_bytes=2000, many=2, swarm=swarm)  # small, so that anchors split by side
    assert sorted(tuple(r) for r in remove_repeats(docs, params=params).collect()) == sorted(want)
    assert remove_repeats(nothing).count() == 0


def test_remove_repeats_of_awkward_ids(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared = text(400)
    cut = lambda edge: text(149) + edge + shared + edge + text(169)
    for ids in ((1, 2), (None, 2), (None, None), (3, 3)):
        rows = [(ids[0], cut("A")), (ids[1], cut("B")), (ids[0], text(900)), (ids[1], text(800)), (9, text(700))]
        got = sorted((r[1], r[2], r[3]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(700, 0, 0), (720, 400, 1), (720, 400, 1), (800, 0, 0), (900, 0, 0)], ids
    twice = [(5, shared), (5, shared), (None, shared[:250]), (5, text(300))]
    got = sorted((r[1], r[2]) for r in remove_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got == [(250, 250), (300, 0), (400, 400), (400, 400)]


def test_run_index():
    """Intervals against counting all windows; the index holds runs, far fewer than bytes in repetitive text."""
    rng = random.Random(12)
    for _ in range(40):
        base = bytes(rng.choice(b"abc") for _ in range(40))
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) + base[rng.randint(0, 30) :] for _ in range(rng.randint(1, 300))]
        seen = Counter(s[i : i + 9] for s in strings for i in range(len(s) - 8))
        want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 8) if seen[s[i : i + 9]] > 1}
        assert {(k, i) for k, a, b in zip(*[x.tolist() for x in repeated_windows(strings, 9)]) for i in range(a, b + 1)} == want
    symbols, _ = _symbols([base * 50] * 40)
    index = build(symbols, len(symbols) - 14, 2100)
    assert len(index.symbols) == len(index.tails) < index.size / 50


def test_mix_sources(docs, nothing, rows):
    got = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    total, share = sum(r.size for r in got), {}
    for r in got:
        share.setdefault(r.source, [r.target, 0, 0])
        share[r.source][1] += r.taken
        share[r.source][2] = max(share[r.source][2], r.size)
    assert abs(sum(t for t, _, _ in share.values()) - total) < 1e-6 * total
    assert all(abs(taken - target) <= largest / 2 + 1 for target, taken, largest in share.values())
    assert mix_sources(nothing).count() == 0


def test_mix_follows_inclusion_odds(spark):
    """Documents of unequal weight are taken as often as their odds say, certain copies apart."""
    rows = [(i, "a b c d", "s", w) for w, n in ((1.0, 3000), (3.0, 2000), (None, 300), (-2.0, 50), (5.0, 400)) for i in range(int(1e6 * (w or 0)) + 10**9, int(1e6 * (w or 0)) + 10**9 + n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").selectExpr("*", "1 AS share", "2 AS size", "3 AS salt")
    got = mix_sources(df, weight_col="w").collect()
    weight = {r[0]: r[3] for r in rows}
    weighed = sum(4 * max(0.0, w or 0.0) for w in weight.values())
    for w in (None, -2.0, 1.0, 3.0, 5.0):
        expected = min(3.0, max(0.0, w or 0.0) * 4 * len(rows) / weighed)
        copies = [r.copies for r in got if weight[r.doc_id] == w]
        p = expected % 1
        assert all(int(expected) <= c <= int(expected) + 1 for c in copies)
        assert abs(sum(copies) / len(copies) - expected) <= 5 * (p * (1 - p) / len(copies)) ** 0.5 + 0.06


def test_pack_documents(docs, nothing, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack_documents(docs).collect()
    assert max(Counter({s: sum(r.length for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got}}).values()) <= 1024
    pieces = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == pieces.get(r.sequence_id, 0)
        pieces[r.sequence_id] = r.offset + r.length
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    copies = Counter(r[0] for r in rows)
    for i, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert sum(r.length for r in by_doc[i]) == copies[i] * len(ids)
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert pack_documents(nothing).count() == 0


def test_token_slices_change_no_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    from groundtable.llm.word_tokens import WordTokens, slices

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, own, rng = Tokenizer.from_file(path), WordTokens(path), random.Random(9)
    signs = list("abcXYZ 019'  \n\t.!_é ßÜ 中　🙂²½ªǅ\x1c\x85\u200b") + ["'s", "'ll", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        want = tool.encode(text, add_special_tokens=False).ids
        assert own.encode([text])[0].tolist() == want
        parts = list(slices(text, 9))
        assert "".join(parts) == text and np.concatenate(own.encode(parts)).tolist() == want


def test_tokens_of_words_with_one_hash():
    import public_tokenizers
    from tokenizers import Tokenizer

    from groundtable.llm.word_tokens import WordTokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, own = Tokenizer.from_file(path), WordTokens(path)
    for size in (512, 1024, 2048, 4096):  # Thue-Morse words: a sum of powers modulo 2**64 doesn't tell them from their complements
        word = "a"
        while len(word) < size:
            word += word.translate(str.maketrans("ab", "ba"))
        texts = [word, word.translate(str.maketrans("ab", "ba")), "plain text " + word]
        for _ in range(2):
            assert [list(ids) for ids in own.encode(texts)] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_cuts_is_least():
    rng = random.Random(1)
    p = PackingParams(width=64)
    for _ in range(30):
        gaps = [rng.randint(1, 40) for _ in range(rng.randint(1, 14))]
        at = np.concatenate([[0], np.cumsum(gaps)])
        pay = np.array([rng.choice([0.0, 2.0]) for _ in at])
        length = {n: 0 if n & (n - 1) == 0 else 64 - n for n in range(1, 65)}

        def price(cuts, at=at, pay=pay):
            inner = sum(p.token_cut for c in cuts[1:] if c not in at)
            return inner + sum(pay[list(at).index(c)] for c in cuts[1:] if c in at) + sum(length[b - a] + p.sequence_cost for a, b in zip(cuts, cuts[1:]))

        best = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                d = at[j] - at[i]
                if d <= 64:
                    best[j] = min(best[j], best[i] + (0 if d == 64 else 64 - d) + p.sequence_cost + pay[j])
                elif d <= 128:
                    best[j] = min(best[j], best[i] + 128 - d + 2 * p.sequence_cost + p.token_cut + pay[j])
        cuts = plan_cuts(at, pay, p)
        assert max(np.diff(cuts)) <= 64 and cuts[0] == 0 and cuts[-1] == at[-1]
        assert price(cuts) <= best[-1] + 1e-9


def test_languages_against_plain_compression(spark):
    """Predictions and scores by compressing each whole text with each dictionary; every language is learnt."""
    import math

    import zstandard

    rng = random.Random(4)
    rows = []
    for i in range(260):
        lang = f"l{i % 30:02d}" if i % 11 else None
        alphabet = [chr(97 + (i % 30 + 3 * k) % 26) for k in range(8)]
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 7))) for _ in range(30 if i % 30 else 6_000)]
        rows.append((i, " ".join(words), lang, i, "x"))
    rows += [rows[3], (990, None, "l01", 1, "x"), (991, "", "l01", 1, "x"), (992, "12 34", None, 1, "x"), (None, "no id at all", "zz", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, found string")
    params = LanguageParams(dictionary_bytes=4_096, sample_bytes=2_048)
    dictionaries = learn_languages(df, params=params)
    learnt = {}
    for i, text, lang, _, _ in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 5 and re.search("[a-z]", text or ""):
            learnt.setdefault(lang, set()).add(text.lower())
    assert set(dictionaries) == set(learnt)
    for lang, content in dictionaries.items():  # whole texts only
        assert {t.decode() for t in content.split(b"\n") if t} <= learnt[lang]
        assert len(content) <= 4_096 or content.decode() in learnt[lang]
    level = zstandard.ZstdCompressionParameters.from_level(params.level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    kind = zstandard.DICT_TYPE_RAWCONTENT
    tools = [(lang, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=kind), compression_params=level)) for lang, c in sorted(dictionaries.items())]
    want = []
    for i, text, _, _, _ in rows:
        held = i is None or zlib.crc32(str(i).encode()) % 5 == 0
        if not re.search("[a-z]", text or ""):
            want.append((i, held, "und", 0.0))
            continue
        sizes = [len(tool.compress(b" " + text.lower().encode() + b" ")) for _, tool in tools]
        best = min(sizes)
        want.append((i, held, tools[sizes.index(best)][0], round(1 / sum(math.exp(-0.5 * (n - best)) for n in sizes), 9)))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in identify_languages(df, params=params).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_toxicity_against_a_scalar_learner(spark):
    """Scores from FTRL-proximal written as a loop over single weights, without calibration."""
    import math

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["ab", "Cd", "ef", "g1", "hé", "bad"]) for _ in range(rng.randint(0, 9))), "x", -1) for i in range(120)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (502, "bad " * 60_000, "x", 1), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(r[0], None if r[0] % 13 == 0 else int("bad" in (r[1] or ""))) for r in rows[:-1]], "doc_id long, toxic int")
    params = FtrlParams(calibration=0.0, l1=0.2, epochs=2)
    slots, weights = train_toxicity(df, labels, params=params)
    got = {r.doc_id: r for r in score_toxicity(df, labels, params=params).collect()}

    def features(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return sorted(_features(data, np.array([0, len(data)]))[1].tolist()) + [1 << 20]

    known = {i: (t, l) for (i, t, _, _), (_, l) in zip(rows, [(r.doc_id, r.toxic) for r in labels.collect()]) if l is not None}
    train = [(i, *known[i]) for i in sorted(known) if zlib.crc32(str(i).encode()) % 5]
    train = [x for x in train for _ in range(2 if x[0] == 0 else 1)]  # the repeated row counts twice
    z, n = Counter(), Counter()

    def weight(k):
        l1 = params.l1 if k < 1 << 20 else 0
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((params.beta + math.sqrt(n[k])) / params.alpha + params.l2)

    learnt = np.random.RandomState(params.epochs).permutation(len(train))
    for epoch in range(params.epochs):
        for i in np.random.RandomState(epoch).permutation(learnt):
            _, text, label = train[i]
            at = features(text)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(k) for k in at))))) - label
            for k, w in [(k, weight(k)) for k in at]:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / params.alpha * w
                n[k] += g * g
    plain = {k: weight(k) for k in z if weight(k)}
    assert set(plain) == set(slots.tolist()) and all(abs(plain[k] - w) < 1e-9 for k, w in zip(slots.tolist(), weights.tolist()))
    for i, text, _, _ in rows:
        score = 1 / (1 + math.exp(-sum(plain.get(k, 0.0) for k in features(text))))
        assert abs(got[i].score - score) < 1e-9 and got[i].predicted == int(score >= 0.5)


def test_languages_and_toxicity(spark, nothing):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    letters = {"aa": "abcdefg", "bb": "nopqrst"}
    vocabulary = {lang: [word(alphabet) for _ in range(80)] for lang, alphabet in letters.items()}
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        bad = i % 5 == 0
        words = rng.choices(vocabulary[lang], k=30) + (["nasty", "vile"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang if i % 7 else None, "s", int(bad)))
    rows += [(900, None, "aa", "s", 0), (901, "12 !?", "bb", "s", 0), (902, "", None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    langs = {r.doc_id: r for r in identify_languages(df.drop("toxic")).collect()}
    assert [langs[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in langs.values())
    hits = [langs[r[0]].lang_pred == ("aa" if r[0] % 2 else "bb") for r in rows[:400]]
    assert sum(hits) >= 0.97 * len(hits)
    labels = df.select("doc_id", "toxic")
    scored = {r.doc_id: r for r in score_toxicity(df, labels).collect()}
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored.values())
    held = [r for r in rows[:400] if scored[r[0]].held_out]
    assert held and sum(scored[r[0]].predicted == r[4] for r in held) >= 0.95 * len(held)
    assert all(scored[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert identify_languages(nothing).count() == 0
    assert score_toxicity(nothing, labels).count() == 0
