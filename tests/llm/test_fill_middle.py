"""Fill-in-the-middle against a plain version on awkward rows."""

import hashlib
import random
import re

from groundtable.llm.fill_middle import FillParams, fill_middle, restore_text

SCHEMA = "doc_id long, text string, n long, form string, digest string, h1 string, output string"


def _plain(doc, text, units):
    text = text or ""
    hexa = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hexa[8 * i : 8 * i + 8], 16) for i in range(4)]
    found = units(text)
    n = len(found)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle = "".join(found[:a]), "".join(found[a:b])
    suffix = text[len(prefix) + len(middle) :]
    if h[3] % 100 < 20:
        return (doc, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def _rows():
    rng = random.Random(11)
    texts = [None, "", " ", "a", "<", "<P", "x<P>y", "x<S>", "<M>", "$1 \\ %d {3}", "a\r\nb c\x85d\n", "é \U0001f600\U0001f468‍\U0001f469 中文", "S><P<S<M>"[:7]]
    texts += ["".join(rng.choice("<>PSM ab\n\U0001f600é") for _ in range(rng.randint(1, 3000))).replace("<P>", "").replace("<S>", "").replace("<M>", "") for _ in range(60)]
    texts += ["word \U0001f600 " * 150_000, "x" * 1024, "y" * 2048, "z" * 1023]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (7, "another text of an id"), (21, "a"), (21, "a")]
    return [(*r, 5, "clash", "d", "h", "o") for r in rows]


def _key(row):
    return tuple((v is None, v) for v in row)


def test_fill_middle(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fill_middle(docs).cache()
    got = sorted((tuple(r) for r in made.collect()), key=_key)
    assert got == sorted((_plain(r[0], r[1], list) for r in rows), key=_key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = sorted(r[0] for r in made.select(restore_text(made["output"], made["form"])).collect())
    assert back == sorted(r[1] or "" for r in rows)
    assert fill_middle(docs.where("false")).collect() == []


def test_fill_middle_by_words(spark):
    rows = [r for r in _rows() if r[1] is None or len(r[1]) < 4000] + [(99, "many words " * 30_000, 5, "c", "d", "h", "o")]
    docs = spark.createDataFrame(rows, SCHEMA)
    params = FillParams(unit=r"\S++\s*+", block=16)
    got = sorted((tuple(r) for r in fill_middle(docs, params=params).collect()), key=_key)

    def words(text):
        out, at = [], 0
        while found := re.compile(r"[^ \t-\r]+[ \t-\r]*").match(text, at):
            out.append(found.group())
            at = found.end()
        return out

    assert got == sorted((_plain(r[0], r[1], words) for r in rows), key=_key)
