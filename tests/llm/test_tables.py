"""Conversations, vectors and pages against plain counterparts, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm import brute
from voxtable.llm import chat_format, embedding_dedup, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["### user: hi</turn>\n", "\\", "\\\\###</turn>", "####\\", "", "a: b", "<|endoftext|> x", "é中🙂 \n\n", "</turn>\n### assistant: no"]


def test_rendering_is_reversible():
    r = random.Random(3)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "a: b", "### x", "\\", ""]), "".join(r.choice([*NASTY, "w "]) for _ in range(r.randrange(6)))) for _ in range(r.randrange(1, 6))]
        text, spans = chat_format.render(turns)
        assert chat_format.parse(text) == turns
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_mask_finds_tokens_by_their_offsets():
    offsets = np.array([(0, 3), (3, 5), (5, 5), (5, 9), (9, 12)])
    flags, covered = chat_format.mask(offsets, [(4, 6), (9, 12)])
    assert flags.tolist() == [0, 1, 1, 1, 1] and covered == [(4, 6), (9, 12)]
    assert chat_format.mask(np.zeros((0, 2), int), [(0, 1)])[1] == [] and chat_format.mask(offsets, [(3, 3)])[1] == []


def test_conversations(spark):
    rows = [(1, 2, "assistant", t) for t in NASTY[:1]] + [(1, 1, "user", None), (1, 1, "user", None), (1, None, "system", "s"), (1, 3, None, "no role"),
            (2, 0, "assistant", "".join(NASTY)), (2, 1, "assistant", NASTY[7]), (None, 0, "assistant", "x"), (3, 0, "user", "only")]
    turns = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(turns, BYTE_BPE)).collect()}
    assert back[1]["roles"] == ["system", "user", "user", "assistant", ""] and back[1]["texts"][1:3] == ["", ""]
    assert back[1]["loss_texts"] == [NASTY[0]] and "".join(back[2]["loss_texts"]) == "".join(NASTY) + NASTY[7]
    assert back[3]["loss_texts"] == [] and back[None]["loss_texts"] == ["x"]
    assert chat_format.format_conversations(turns.limit(0), BYTE_BPE).collect() == []


def vectors():
    r = np.random.default_rng(2)
    near = lambda v, s: (v + r.normal(0, s, len(v))).tolist()
    base = [r.normal(size=16) for _ in range(6)]
    rows = [(k, near(base[k % 6], 0.05 if k % 2 else 0.8), k % 2) for k in range(400)]
    same = rows[7][1]
    rows += [(500 + k, same, 1) for k in range(4)] + [(510, same, 0), (511, [2 * x for x in same], 1), (512, same, None)]
    rows += [(520, None, 1), (521, [0.0] * 16, 1), (522, [float("nan")] * 16, 1), (523, [None] + [1.0] * 15, 1), (524, [float("inf")] * 16, 1), (525, [1.0, 2.0], 1), (526, [1.0, 2.0], 1)]
    return [*rows, rows[7], (None, same, 1)]


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CENTRE", 40)
    rows = vectors()
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    good = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    links, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if p is not None and p == q and good(x) and good(y) and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.98:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    root = brute.components(range(len(rows)), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min(x for x in (least.get(root[k]), i) if x is not None) if not (least.get(root[k]) is None and i is None) else None
    expected = sorted(((i, n[k], least[root[k]], i == least[root[k]]) for k, (i, _, _) in enumerate(rows)), key=str)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup(frame).collect()), key=str)
    assert got == expected
    assert embedding_dedup.dedup(frame.limit(0)).collect() == []


def test_graph_search_reaches_most_of_the_range():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(300, 32)), r.normal(size=32) + r.normal(0, 0.08, (200, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = [np.array(q) for q in embedding_dedup.build(x)]
    assert max(map(len, links)) <= 2 * embedding_dedup.DEGREE
    found = sum(len(embedding_dedup.search(v, x, links, 0, 0.98)) for v in x)
    assert found >= 0.99 * (x @ x.T >= 0.98).sum()


PAGES = [(1, "http://www.B.example.com/x?q=1", "a" * 2000), (2, "https://a.example.com/", "a" * 2000), (3, "https://a.example.com/", "short"), (4, "https://a.example.com/", "short"),
         (5, None, None), (6, "not a url", "é" * 700), (7, "http://[bad", ""), (8, "http://a.example.com:80/p", "é" * 700), (9, "http://z.org/\r\n\r\nx", "p\r\n\r\nq" * 400),
         (2, "https://a.example.com/", "a" * 2000), (None, "http://n.example", "a" * 2000), (10, "http://z.org", "Content-Length: 3\r\n\r\n")]


def test_audit_sees_what_small_groups_lost(spark):
    rng = np.random.default_rng(4)
    near = lambda v, n: [list(map(float, v + 0.001 * rng.standard_normal(8))) for _ in range(n)]
    rows = near(rng.standard_normal(8), 60) + [v for _ in range(20) for v in near(rng.standard_normal(8), 2)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    nodes = embedding_dedup.nodes_of(frame, "vec_id", "embedding", "label").cache()
    links = embedding_dedup.linked(nodes).cache()
    assert embedding_dedup.audit(nodes, links) == 1.0
    large = nodes.where("id < 60").select("node")
    kept = links.join(large.withColumnRenamed("node", "a"), "a", "left_semi")  # the pairs are lost: 20 links of 1790
    assert 0.4 < embedding_dedup.audit(nodes, kept, sample=400) < 0.8
    assert embedding_dedup.audit(nodes.limit(0), links.limit(0)) == 1.0


def test_recall_that_stays_low_is_told(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit", lambda *_: 0.5)
    monkeypatch.setattr(embedding_dedup, "MAX_OVERLAP", 3)
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {r["recall"] for r in embedding_dedup.dedup(frame).collect()} == {0.5}


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, key string")
    archive = warc.write(pages)
    found = warc.lookup(archive, warc.keys_of(pages)).collect()
    expected = []
    for i, url, html in PAGES:
        data = (html or "").encode()
        best = max((j for j, _, h in PAGES if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and best is not None and best != i and sum(1 for _, _, h in PAGES if h == html) > 1
        expected.append((warc.key_of(url), i, "revisit" if revisit else "response", best if revisit else None, hashlib.sha1(data).hexdigest(), len(data), None if revisit else html or ""))
    order = ["key", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    assert sorted((tuple(r[c] for c in order) for r in found), key=str) == sorted(expected, key=str)
    one = warc.lookup(archive, spark.createDataFrame([("com,example,a)/",), ("none)/",)], "key string")).collect()
    assert sorted(r["page_id"] for r in one) == [2, 2, 3, 4]
    assert warc.lookup(archive, warc.keys_of(pages)).rdd.getNumPartitions() == warc.SHARDS  # few blocks, yet many readers
    none = pages.limit(0)
    assert warc.lookup(warc.write(none), warc.keys_of(none)).collect() == []


@pytest.mark.parametrize("url,key", [("http://www.B.example.com:8080/x?q=1#f", "com,example,b)/x?q=1"), ("https://a.org", "org,a)/"), (None, ""), ("plain", "plain")])
def test_keys_reverse_the_host(url, key):
    assert warc.key_of(url) == key
