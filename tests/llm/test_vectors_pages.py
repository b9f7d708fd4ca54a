"""Vectors and pages against brute force and round trips."""

import base64
import gzip
import hashlib
import itertools
import re

import numpy as np
import pytest

from groundtable.llm.dom import parse
from groundtable.llm.embedding_dedup import CapParams, near_vectors
from groundtable.llm.html_extract import _extract, extract_pages, marginals, potentials, train_extractor
from groundtable.llm.warc import archive_pages, register_warc, write_pages


def test_near_vectors(spark):
    rng = np.random.RandomState(3)
    centres = rng.randn(30, 16)
    rows = [(i, [float(x) for x in centres[i % 30] + 0.05 * rng.randn(16)], int(i % 3)) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 16, 0)]
    rows += [(305, [float("nan")] + [1.0] * 15, 0), (306, [None] + [1.0] * 15, 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS id", "1 AS copies", "2 AS unit")
    got = {r.vec_id: r for r in near_vectors(df, params=CapParams(tile_rows=8)).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    links = {i: 0 for i in got}
    root = {i: i for i in got}
    for a, b in itertools.combinations(sorted(good), 2):
        x, y = good[a], good[b]
        if label[a] == label[b] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.95 * sum(links.values()) and all(r.n_links <= links[i] for i, r in got.items())
    if found == sum(links.values()):
        assert all(r.component_id == root[i] and r.kept == (root[i] == i) for i, r in got.items())
    assert near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_recall(spark, kind):
    """Planted pairs just above and just below the least cosine, among others, against all pairs."""
    rng = np.random.RandomState(8)
    base = rng.randn(400, 64)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i, v in enumerate(base):
        side = rng.randn(64)
        side -= (side @ v) * v
        side /= np.linalg.norm(side)
        c = rng.choice([0.9299, 0.9301, 0.94, 0.97])
        rows += [v, (c * v + np.sqrt(1 - c * c) * side) * rng.uniform(0.1, 9)]
    precision = np.float32 if kind == "float" else np.float64
    matrix = np.array(rows).astype(precision)
    labels = [None if i % 97 == 0 else f"l{i // 2 % 2}" for i in range(len(rows))]
    df = spark.createDataFrame([(i, v.tolist(), l) for i, (v, l) in enumerate(zip(matrix, labels))], f"vec_id long, embedding array<{kind}>, label string")
    got = {r.vec_id: r for r in near_vectors(df, params=CapParams(rows_per_cap=8)).collect()}
    unit = matrix.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    linked = (unit @ unit.T >= 0.93) & same & ~np.eye(len(rows), dtype=bool)
    want = linked.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 400
    for i in np.flatnonzero(found):
        assert got[i].component_id in np.flatnonzero(linked[i]) or got[i].component_id == i


def test_marginals_match_enumeration():
    rng = np.random.RandomState(0)
    parents, depths = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    unary, pair = rng.randn(6, 2), rng.randn(6, 2, 2)
    mass = np.zeros((6, 2))
    for state in itertools.product((0, 1), repeat=6):
        log = sum(unary[i, state[i]] for i in range(6)) + sum(pair[i, state[parents[i]], state[i]] for i in range(1, 6))
        for i in range(6):
            mass[i, state[i]] += np.exp(log)
    assert np.allclose(marginals(parents, depths, unary, pair), mass[:, 1] / mass.sum(1))


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=a>Home</a></ul></nav>"
    "<div class=ad>Buy now. It is cheap.</div><{0}><h1>Title {1}</h1><p><b>First  paragraph &amp; more.<br><p>Second\n one is longer. It goes on.</p>"
    "<div class=comments><p>Nice post. I agree with it all.</p></div></{0}><footer>&copy; 2024</footer></body></html>"
)


PARAGRAPHS = "".join(f"<p>This is paragraph {i}. It goes on for a while, as such texts do, and then it ends.</p>" for i in range(4))
LINES = [f"This is paragraph {i}. It goes on for a while, as such texts do, and then it ends." for i in range(4)]
CASES = [  # (page, its main text)
    (f'<body class="no-sidebar"><nav><a href=x>Home</a></nav><article class="post has-comments"><h1>T</h1>{PARAGRAPHS}</article>', ["T", *LINES]),
    (f'<article><h1>T</h1><div class="social-science">{PARAGRAPHS}</div></article>', ["T", *LINES]),
    (f'<article><header><h1>Title</h1></header>{PARAGRAPHS}<footer>tags</footer></article><header><h1>Site</h1></header>', ["Title", *LINES]),
    (f'<article>{PARAGRAPHS}<p>Some <span class="advert">Buy now</span> text <span hidden>no</span><i style="display:none">no</i> on.</p></article>', [*LINES, "Some text on."]),
    (f'<div class="banner"><article>{PARAGRAPHS}<div class="ad-slot"><p>Cheap things. Buy them.</p></div></article></div>', LINES),
    (f'<article>{PARAGRAPHS}<aside>More on it. Read it.</aside><form>Name: <input><button>Go</button></form><div id="comments"><p>Nice. I agree.</p></div></article>', LINES),
    (f'<div id="content"><h1>Title</h1>{PARAGRAPHS}</div><div id="cookie-notice">We use cookies. Accept them.</div>', ["Title", *LINES]),
]


def _plain(page, model):
    """Extraction with marginals by summing over all states of a small tree."""
    tree = parse(page)
    score, coupling = potentials(tree, model)
    size = len(tree.tags)
    mass = np.zeros((size, 2))
    for state in itertools.product((0, 1), repeat=size):
        log = sum(score[i] for i in range(size) if state[i])
        log += sum(coupling[i] / 2 * (1 if state[i] == state[tree.parents[i]] else -1) for i in range(1, size))
        for i in range(size):
            mass[i, state[i]] += np.exp(log)
    blocks = {}
    for element, block, run in tree.texts:
        if mass[element, 1] >= mass[element, 0]:
            blocks[block] = blocks.get(block, "") + run
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks.values()) if t)


def test_extraction_cases_and_enumeration(spark):
    rows = [(i, f"u{i}", PAGE.format("article", i)) for i in range(40)] + [(100 + i, None, page) for i, (page, _) in enumerate(CASES)]
    long = "<article>" + "<p>A sentence of a long page. And one more.</p>" * 40_000 + "</article>"
    rows += [(200, "u", long), (201, "u", "<div>" * 60_000 + "</i>" * 60_000 + "x"), rows[3], (3, "other", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'y' AS text", "1 AS n_chars", "2 AS place")
    model = train_extractor(df)
    got = {}
    for r in extract_pages(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert [got[100 + i][0].text.split("\n") for i in range(len(CASES))] == [want for _, want in CASES]
    assert got[200][0].text == "\n".join(["A sentence of a long page. And one more."] * 40_000)
    assert sorted(r.n_chars for r in got[3]) == sorted([0, len(got[4][0].text), len(got[4][0].text)])  # a repeated row, and its id with another page
    small = [page for page, _ in CASES if len(parse(page).tags) <= 14] + ["<p>a. b.<p>c", "<div class=ad>x. y.</div><h1>T</h1><p>Some. Text.", "plain"]
    assert len(small) >= 6 and [_extract([parse(p)], model)[0] for p in small] == [_plain(p, model) for p in small]


def test_names_that_an_article_has_too(spark):
    """Names that point both ways cost no article text, and still mark boilerplate."""
    pages = [(i, "u", PAGE.format(tag, i)) for i, tag in enumerate(["article", "main"] * 6)]
    model = train_extractor(spark.createDataFrame(pages, "page_id long, url string, html string"))
    body = "<html><body><nav><a href=a>Home</a></nav>%s<footer>&copy; 2024</footer></body></html>"
    long = "A full paragraph of the article. It has two sentences."
    cases = {
        f'<main><p class="search-text">{long}</p><p>Another one, with more. And more.</p></main>': f"{long}\nAnother one, with more. And more.",
        f'<div class="social-science"><h1>T</h1><p>{long}</p></div>': f"T\n{long}",
        f'<div class="comment-policy"><h1>T</h1><p>{long}</p></div>': f"T\n{long}",
        f'<article><div class="header"><h1>Real Title</h1></div><p>{long}</p></article>': f"Real Title\n{long}",
        f'<article><h1>T</h1><p>{long}</p><div class="social"><a href=b>Share this.</a></div><div class="search"><a href=c>Find</a></div></article>': f"T\n{long}",
        f'<article><h1>T</h1><p>{long}</p><div class="comments"><p>I agree. It is so.</p></div><p class="advert">Buy now. It is cheap.</p></article>': f"T\n{long}",
    }
    assert _extract([parse(body % c) for c in cases], model) == list(cases.values())


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE.format("article", i)) for i in range(40)] + [(90, "u", None), (91, None, ""), (92, "u", "<p>unclosed <i>text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'y' AS text", "1 AS id")
    got = {r.page_id: r for r in extract_pages(df).collect()}
    assert len(got) == len(rows) and got[90].text == "" and got[91].text == ""
    assert got[3].text == "Title 3\nFirst paragraph & more.\nSecond one is longer. It goes on." and got[3].n_chars == len(got[3].text)
    disguised = _extract([parse(PAGE.format("section", 1))], train_extractor(df))[0]
    assert "Second one is longer" in disguised and "Nice post" not in disguised and "Home" not in disguised and "Buy" not in disguised
    assert extract_pages(df.where("false")).count() == 0


def test_warc_lines_may_end_in_lf(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\nContent-Length: 5\n\nhello"
    head = b"WARC/1.1\nWARC-Type: response\nWARC-Record-ID: <urn:record:7>\nContent-Type: application/http\nContent-Length: %d\n\n" % len(block)
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:8>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head + block + b"\n\n" + bare)
    register_warc(spark)
    got = {r.record_id: bytes(r.payload) for r in spark.read.format("warc").load(str(tmp_path)).collect()}
    assert got == {"7": b"hello", "8": b"hi"}


def test_warc_repeats_and_files(spark, tmp_path):
    """Repeated ids, ties and a large group against the rule; the files hold dated records and nothing temporary."""
    rows = [(i, "u", "same") for i in range(50)] + [(0, "u", "same"), (3, "v", "other"), (3, "v", "third"), (None, "w", "fourth"), (None, "w", "fourth"), (77, "w", "third")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "5 AS key", "6 AS sha256", "7 AS first", "8 AS head").repartition(5)
    write_pages(df, str(tmp_path / "w"))
    first = {}
    for i, _, body in rows:
        first[body] = min(first.get(body, 1 << 60), 1 << 60 if i is None else i)
    want = sorted((str(i), body, first[body] not in (i, 1 << 60) or (i is None and first[body] < 1 << 60)) for i, _, body in rows)
    got = spark.read.format("warc").load(str(tmp_path / "w")).collect()
    digest = {base64.b32encode(hashlib.sha1(b.encode()).digest()).decode(): b for b in first}
    assert sorted((str(r.record_id), digest[r.payload_digest], r.record_type == "revisit") for r in got) == want
    assert all(r.refers_to == str(first[digest[r.payload_digest]]) for r in got if r.record_type == "revisit")
    names = [p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")]
    assert names and all(n.startswith("part-") for n in names)
    for path in (tmp_path / "w").iterdir():
        if path.name.endswith(".gz"):
            for record in gzip.open(path).read().split(b"WARC/1.1\r\n")[1:]:
                assert re.search(rb"^WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r$", record.split(b"\r\n\r\n")[0] + b"\r", re.M)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "ä" * 5000), (2, "http://b/", "ä" * 5000), (3, None, None), (4, "x\ny", ""), (None, "u", "q"), (6, "u", "q"), (7, "big", "z\r\n" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS id")
    records = archive_pages(df)
    got = {r.record_id: r for r in records.collect()}
    assert len(got) == len(rows)
    for i, _, text in rows:
        body, r = (text or "").encode(), got[None if i is None else str(i)]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == "revisit" or bytes(r.payload) == body
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {"2": "1", "4": "3", None: "6"}
    revisits = records.where("record_type = 'revisit' AND record_id IN ('2', '4')").select("record_id")
    assert sorted(r[0] for r in revisits.collect()) == ["2", "4"]
    assert archive_pages(df.where("false")).count() == 0
