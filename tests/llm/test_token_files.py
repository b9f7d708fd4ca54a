"""Token files: exact round trips, ids of the plain tokenizer, damage."""

import glob
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundtable.llm.chunk_tokens import ChunkTokens
from groundtable.llm.token_coder import decode, encode, prior_table
from groundtable.llm.token_files import DamagedFile, Segment, TokenParams, coded_documents, pack_segment, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["equal", "cycle", "random", "skewed", "wide"])
def test_coder_round_trip(kind):
    rng = np.random.RandomState(1)
    for blocks, steps, last in ((1, 1, 1), (3, 40, 7), (7, 700, 1), (5, 1100, 1100)):
        lengths = np.array([steps] * (blocks - 1) + [last])
        size = (steps if blocks > 1 else last, blocks)
        ids = {
            "equal": lambda: np.full(size, 65_535),
            "cycle": lambda: np.add.outer(np.arange(size[0]), np.arange(size[1])) % 7,
            "random": lambda: rng.randint(0, 65_536, size),
            "skewed": lambda: np.minimum(rng.zipf(1.3, size), 65_535),
            "wide": lambda: rng.permutation(65_536)[: size[0]][:, None].repeat(size[1], 1),
        }[kind]().astype(np.int64)
        prior = prior_table(np.bincount(ids.ravel(), minlength=65_536))
        coded = encode(ids, lengths, prior, 256)
        found = decode(coded, lengths, prior, 256)
        for i, n in enumerate(lengths):
            assert np.array_equal(found[:n, i], ids[:n, i])
        alone = decode([coded[-1]], lengths[-1:], prior, 256)
        assert np.array_equal(alone[:, 0], ids[: lengths[-1], -1])


def test_coder_uses_contexts():
    """Ids that repeat in their context cost far less than by their frequency."""
    rng = np.random.RandomState(2)
    phrase = rng.randint(0, 5000, 150)
    ids = np.concatenate([phrase] * 13)[:1900, None].repeat(4, 1).astype(np.int64)
    prior = prior_table(np.bincount(ids.ravel()))
    assert sum(map(len, encode(ids, np.full(4, 1900), prior, 1024))) * 8 / ids.size < 2.2 < np.log2(150)


def test_chunks_give_the_tokenizers_ids():
    rng, own, tool = random.Random(3), ChunkTokens(PATH, limit=300), Tokenizer.from_file(PATH)
    assert own._letters is not None
    signs = ["a", "B", "ñ", "Œ", "ŉ", "ǆ", "Ǆ", "ª", "ĸ", "Thé", "ſ", "ß", "ǰ", "Ʒ", "kK"] + ["a", "B", " ", "\x1c", "\x1f", "\x85", "\xa0", "é", "é", "́", "<|endoftext|>", "<|startoftext|>", "'s", "don't", "1", "½", "İ", "Σ", "ß", "中", "　", "!", "\n", "​", "\U0001f600", "\x00", "x" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for first in range(0, len(texts), 100):
        part = texts[first : first + 100]
        assert [list(x) for x in own.encode(part)] == [tool.encode(t, add_special_tokens=False).ids for t in part]


def test_latin_words_one_by_one():
    own, tool = ChunkTokens(PATH), Tokenizer.from_file(PATH)
    signs = [chr(c) for c in range(0x260) if not chr(c).isspace()]
    for word in [w for c in signs for w in (c, f"a{c}b", f"{c}.", f"A{c.upper()}")]:
        assert own.encode([word])[0].tolist() == tool.encode(word, add_special_tokens=False).ids, word


def _plain(rows):
    tool, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 3 % 211, " ".join(rng.choice(["The", "cat", "zürich", "12", "\x1c", "中文", "unseenword" + str(i)]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (-5, "long text here " * 20_000), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, start long, ids int, place int").repartition(3)
    params = TokenParams(block_ids=64, segment_ids=5_000, file_ids=12_000)
    got = coded_documents(docs, params=params).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == _plain(rows)
    whole = coded_documents(docs).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, whole), key=lambda r: r[1]) == _plain(rows)
    assert coded_documents(docs.where("false")).collect() == []

    again = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id = 6").withColumn("text", F.lit("another text")))
    found = sorted(map(tuple, coded_documents(again).select("start", "n_tokens", "doc_id", F.crc32("ids")).collect()))
    assert [r[0] for r in found] == np.cumsum([0] + [r[1] for r in found])[:-1].tolist()
    assert sorted((r[2] is None, r[2] or 0) for r in found) == [(r[2] is None, r[2] or 0) for r in found]
    assert sorted((r[2] or 0, r[3]) for r in found) == sorted((r[0] or 0, r[3]) for r in _plain(rows + [r for r in rows if r[0] is not None and r[0] < 40] + [(6, "another text")]))

    folder = str(tmp_path / "tokens")
    write_tokens(docs, folder, params=params)
    assert len(glob.glob(folder + "/part-*.tids")) > 3 and not glob.glob(folder + "/_part-*")
    name = max(glob.glob(folder + "/part-*.tids"), key=lambda n: len(open(n, "rb").read()))
    data = bytearray(open(name, "rb").read())
    data[-20] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        read_tokens(spark, folder).collect()


def test_blocks_alone_and_damage():
    rng = np.random.RandomState(6)
    ids = rng.randint(0, 400, 1000).astype(np.uint32)
    packed = pack_segment(ids, [(5, 300, False), (None, 700, False)], 64)
    segment = Segment(io.BytesIO(packed))
    assert np.array_equal(segment.ids(), ids)
    assert np.array_equal(segment.ids([15, 3]), np.concatenate([ids[3 * 64 : 4 * 64], ids[15 * 64 :]]))
    for at in (5, 40, len(packed) - 12):  # of the last words only those count that the ids depend on
        broken = bytearray(packed)
        broken[at] ^= 16
        with pytest.raises(DamagedFile):
            Segment(io.BytesIO(bytes(broken))).ids()
    with pytest.raises(DamagedFile):
        Segment(io.BytesIO(packed[:-1])).ids()
