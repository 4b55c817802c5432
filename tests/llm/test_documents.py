"""Document operators against plain counterparts, on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from voxtable.llm import bpe, minhash, packing, quality_rules, substring_dedup, suffix_dedup, toxicity

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, n_words int, kept boolean, id string, keep_0 int, ids string, c0 int, toxic int"


def made_up() -> list[tuple]:
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "beta", "gamma", "Δelta", "naïve", "o'neil", "x", "日本", "1984", "don't"]) + str(r.randrange(40))
    base = [" ".join(word() for _ in range(n)) for n in (120, 300, 80, 60, 700)]
    texts = [None, "", "   \n\t", "one", "one two three four", "!!!! " * 300, "a" * 3000, "<|endoftext|> x <|endoftext|>", "# $ %\nsame line\nsame line\n\n", *base]
    for b in base:
        w = b.split(" ")
        texts += [b, b.upper(), " ".join([*w[:30], "changed", *w[31:]]), " ".join([word() for _ in range(40)] + w[:55] + [word() for _ in range(60)])]
    texts.append(" ".join(word() for _ in range(6000)) + " " + base[1])
    rows = [(k, t, f"h{k % 3}" if k % 7 else None) for k, t in enumerate(texts)]
    return [*rows, rows[9], rows[0], (None, base[2], "h0")]


@pytest.fixture(scope="module")
def rows():
    return made_up()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, True, "a", 2, "b", 3, 4) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(rows):
    """Rows with an id, each once."""
    return list(dict.fromkeys((i, t) for i, t, _ in rows if i is not None))


def by_id(frame, *columns):
    found = {}
    for r in frame.collect():
        found.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return found


def test_quality_rules(docs, rows):
    found = by_id(quality_rules.assess(docs), *quality_rules.MEASURES, "base_failed", "host_rate")
    for i, t, s in rows:
        m = brute.measures(t)
        for got in found[i]:
            assert list(got[:5]) == m
            assert got[5] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
            assert (got[6] is None) == (s is None)
    assert sum(map(len, found.values())) == len(rows)


def test_prior_pulls_small_hosts_more():
    a, b = quality_rules.beta_prior(3, 210, 105, 100.0 ** 2 * 2 + 100, 90.0 ** 2 / 100 + 10.0 ** 2 / 100 + 25 / 10)
    small, large = (10 + a) / (10 + a + b), (90 + a) / (100 + a + b)
    assert 0.5 < small < 1 and 0.8 < large < 0.91
    assert quality_rules.beta_prior(0, 0, 0, 0, 0) == (1.0, 1.0)
    assert quality_rules.beta_prior(1, 10, 5, 100, 2.5) == (0.5, 0.5)


def test_bad_host_goes_whole(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, good, "fine") for k in range(30)] + [(100 + k, bad, "junk") for k in range(29)] + [(200, good, "junk"), (201, bad, None), (202, good, None)]
    kept = {r["doc_id"] for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {*range(30), 202}


def test_bpe_round_trip(docs, rows):
    library = Tokenizer.from_file(BYTE_BPE)
    found = by_id(bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE), "ids", "decoded")
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected = (struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False))
        assert any((bytes(x), y) == expected for x, y in found[i])


def test_bpe_words_like_the_library():
    automaton, library = bpe.Automaton(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    r = random.Random(2)
    encoder = bpe.Encoder(automaton)
    for _ in range(3000):
        text = "".join(r.choice("abcdetnioh  \n\t'<|>éß中🙂.,12s") for _ in range(r.randrange(50)))
        assert np.frombuffer(encoder.text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows):
    library = Tokenizer.from_file(WORD_BPE)
    pieces = packing.pack(docs, WORD_BPE).collect()
    fill = {}
    for p in pieces:
        fill.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    whole = {}
    for p in pieces:
        whole.setdefault(p["doc_id"], []).append((p["start"], p["doc_tokens"], bytes(p["ids"])))
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        if sum(1 for j, _, _ in rows if j == i) == 1:
            assert b"".join(x for _, _, x in sorted(whole[i])) == struct.pack(f"<{len(ids)}I", *ids)
            assert {n for _, n, _ in whole[i]} == {len(ids)}
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(p["length"] for p in pieces) == sum(count(t) for _, t, _ in rows)


def test_harmonic_bins():
    """Bins of class k hold k whole documents; only fillers of gaps are cut; what is given out and what is held cover all tokens."""
    r = np.random.default_rng(1)
    for most in (5, 100, 5000, 20000):
        for _ in range(40):
            n = r.integers(1, most, r.integers(0, 300))
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            full, rest = packing.whole(n, at[:-1], 4096)
            placed, into, offset, held = packing.harmonic(rest)
            for b in range(into.max(initial=-1) + 1):
                own = np.flatnonzero(into == b)
                own = own[np.argsort(offset[own])]
                assert (offset[own] == np.cumsum(placed.length[own]) - placed.length[own]).all() and placed.length[own].sum() == 4096
                first = placed.length[own[0]]
                k = 4096 // first
                assert (4096 // placed.length[own[:k]] == k).all() and (placed.length[own[:k]] == n[placed.row[own[:k]]] % 4096).all()
            every = packing.joined([full, placed, held])
            order = np.argsort(every.first)
            assert (every.first[order] == np.cumsum(every.length[order]) - every.length[order]).all() and every.length.sum() == n.sum()
            assert (every.first - at[every.row] == every.start).all()
            assert len(placed.row) + len(held.row) <= len(rest.row) + 2 * (into.max(initial=-1) + 1) + 1


def test_packing_pieces_a_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    pieces = packing.pack(docs, WORD_BPE).groupBy("doc_id").count()
    assert pieces.agg({"count": "avg"}).first()[0] < 2


def test_packing_words_beyond_the_table(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    import pyarrow as pa

    words, library = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in ("a b c d e", "c d Ωmega Ａ é f g h", "<|endoftext|>x 'll don't 42", "a c h zz"):
        flat, at = words.batch(pa.array([text, ""], pa.large_string()))
        assert flat.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2, 2] and at.tolist()[-1] == len(flat)


def test_minhash(docs, unique, rows):
    found = by_id(minhash.dedup(docs), "n_shingles", "component_id", "kept")
    expected = brute.near(unique)
    for i, (n, part) in expected.items():
        assert set(found[i]) == {(n, part, i == part)}, i
    assert found[None] == [(len(brute.shingles(rows[-1][1])), found[11][0][1], False)]
    assert sum(map(len, found.values())) == len(rows)


def test_minhash_chain_and_crowded_band(spark):
    """Near copies in a chain are one component though its ends are far apart; texts in one band need not be linked."""
    r = random.Random(3)
    w = [f"w{r.randrange(10 ** 6)}" for _ in range(120)]
    rows, text = [], w[:]
    for k in range(25):
        rows.append((k, " ".join(text)))
        text[4 * k:4 * k + 1] = [f"z{k}"]
    rows += [(100 + k, " ".join(w[:70] + [f"y{k}{j}" for j in range(50)])) for k in range(20)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.near(rows)


def test_minhash_clean_leaves_one_of_repeated_rows(docs):
    kept = [r["doc_id"] for r in minhash.clean(docs, percent=80).collect()]
    assert kept.count(9) == 1 and 14 not in kept


def test_clean_judges_rows_of_null_and_shared_ids(spark):
    """One row of each component, though ids are null or shared; a failing row goes, though a row of its id passes."""
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
    a, b, c, d = (words(120) for _ in range(4))
    near = lambda w, k: " ".join([*w[:-k], *words(k)])
    texts = [(1, near(a, 1)), (None, near(a, 2)), (None, near(b, 1)), (None, near(b, 2)), (None, " ".join(d)), (7, near(c, 1)), (7, near(c, 2)), (8, near(c, 3))]
    left = [(x["doc_id"], x["text"]) for x in minhash.clean(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    heads = sorted((str(i), t.split(" ")[0]) for i, t in left)
    assert heads == sorted([("1", a[0]), ("None", b[0]), ("None", d[0]), ("7", c[0])]) and set(left) <= set(texts)
    rows = [(None, " ".join(a), None), (None, "too short", None), (3, " ".join(b), "h"), (3, "short too", "h"), (4, " ".join(c), None)]
    left = quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_host_rate=0.9).collect()
    assert {tuple(x) for x in left} == {rows[0], rows[2], rows[4]} and len(left) == 3


def test_posterior_bound():
    assert minhash.least_matches(24, 0.85, 1e-9) < minhash.least_matches(24, 0.85, 1e-3) < 24
    assert minhash.least_matches(120, 0.85, 0.5) in range(98, 106)


@pytest.mark.parametrize("window", [5, 50])
def test_substring_dedup(docs, rows, unique, window):
    found = by_id(substring_dedup.dedup(docs, window=window), "n_words", "n_removed", "kept_text", "removed")
    flags = brute.removed_words([*unique, (-1, rows[-1][1])], window)  # a missing id is the smallest
    for i, t in unique:
        w, f = brute.words(t), flags[i]
        for n, gone, kept, spans in found[i]:
            assert (n, kept) == (len(w), " ".join(x for x, g in zip(w, f, strict=True) if not g))
            assert {k for s in spans for k in range(s["first"], s["after"])} == {k for k, g in enumerate(f) if g}
            assert gone == sum(f)
    assert found[None][0][1] == 0


def test_substring_dedup_repeated_row_in_two_batches(spark):
    """A row beside a smaller id that holds some of its windows, and once more in another partition."""
    r = random.Random(6)
    part = lambda n: [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
    a, b, c, d = part(60), part(90), part(90), part(60)
    small, other, text = " ".join(a + part(20)), " ".join(part(20) + c), " ".join(a + b + c + d)
    batches = [[(1, small), (9, text)], [(9, text)], [(2, other)]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(batches, 3).flatMap(list), "doc_id long, text string")
    assert docs.rdd.glom().map(len).collect() == [2, 1, 1]
    flags = brute.removed_words([(1, small), (2, other), (9, text)])[9]
    w = text.split(" ")
    found = by_id(substring_dedup.dedup(docs), "n_removed", "kept_text")
    assert found[9] == [(sum(flags), " ".join(x for x, g in zip(w, flags, strict=True) if not g))] * 2 and sum(flags) == 150


@pytest.mark.parametrize("length,steps", [(400, (200, 25, 1)), (60, (20, 5, 1)), (30, (1,))])
def test_suffix_dedup(docs, rows, length, steps):
    found = by_id(suffix_dedup.dedup(docs, length=length, steps=steps), "n_bytes", "n_removed", "kept_bytes", "removed")
    for (i, t, _), f in zip(rows, brute.removed_bytes([(i, t) for i, t, _ in rows], length), strict=True):
        data = (t or "").encode()
        expected = (len(data), sum(f), bytes(c for c, g in zip(data, f, strict=True) if not g), sum(1 for k in range(len(f)) if f[k] and not (k and f[k - 1])))
        assert expected in [(n, gone, bytes(kept), len(spans)) for n, gone, kept, spans in found[i]], i
    assert sum(map(len, found.values())) == len(rows)


def test_suffix_dedup_segments(monkeypatch, spark):
    """Texts beyond a segment are cut with overlap and give the same result."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    r = random.Random(1)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = part(900)
    rows = [(1, part(2500) + shared + part(1000)), (2, part(300) + shared), (3, part(5000))]
    data = suffix_dedup.Bytes(*_raw(rows))
    doc, place, lo, hi = data.places(400, 200)
    assert (hi >= lo).all() and {int(d) for d in doc} == {0, 1, 2}
    flags = {i: f for (i, _), f in zip(rows, brute.removed_bytes(rows, 400), strict=True)}
    found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["n_removed"] for x in found} == {i: sum(f) for i, f in flags.items()}


def test_suffix_dedup_segment_borders(monkeypatch, spark):
    """A place that stands for strings on both sides of a segment border is one place, not its own repeat."""
    r = random.Random(8)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = part(700)
    rows = [(1, part(5000)), (2, part(2000) + shared + part(1500)), (3, part(450)), (4, part(250) + shared), (5, part(3100))]
    data = suffix_dedup.Bytes(*_raw(rows))
    for step in (200, 25, 1):
        whole = data.places(400, step)
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "SEGMENT", 500)
            assert all(np.array_equal(a, b) for a, b in zip(whole, data.places(400, step), strict=True)), step
    flags = brute.removed_bytes(rows, 400)
    found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), segment=500).collect()
    assert {x["doc_id"]: x["n_removed"] for x in found} == {i: sum(f) for (i, _), f in zip(rows, flags, strict=True)}
    assert sum(map(sum, flags)) == 1400


def _raw(rows):
    import pyarrow as pa

    from voxtable.llm.arrow import raw

    return raw(pa.array([t for _, t in rows], pa.large_string()))


def test_suffix_clean_keeps_columns(docs):
    cleaned = suffix_dedup.clean(docs)
    assert cleaned.schema.names == docs.schema.names and cleaned.count() == docs.count()


@pytest.mark.parametrize(("rule", "n"), [(int.__and__, 1200), (int.__xor__, 3000)])
def test_toxicity_learns_pairs(spark, rule, n):
    """Insults and group names say little alone (and) or nothing at all (xor); only together they decide."""
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        insult, group = k % 2, (k // 2) % 2
        w = [f"w{r.randrange(300)}" for _ in range(30)] + ["Nasty!"] * insult + ["martians"] * group
        r.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, rule(insult, group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame(labels[:-300], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score(docs, machine, threshold=0.5).collect()}
    assert sum(got[k] == y for k, y in labels[-300:]) >= 0.95 * 300


def test_registered_toxicity_on_held_out_rows(spark):
    from voxtable.llm import queries

    folder = "/root/testdata/sf0.1"
    labels = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [x for x in queries.QUERIES["op9_toxicity"](spark, folder).collect() if x["held_out"] and labels.get(x["doc_id"]) is not None]
    assert all(x["predicted"] == (x["score"] >= 0.3) for x in found)
    toxic, clean = ([x["predicted"] for x in found if labels[x["doc_id"]] == y] for y in (1, 0))
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.02


def test_toxicity_edges(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(found) == len(rows) and {round(x["toxicity"], 6) for x in found} == {0.0}
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 1), (4, 0), (0, 0)], "doc_id long, toxic int")
    assert toxicity.clean(docs, toxicity.fit(docs, odd)).schema.names == docs.schema.names


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for frame in (quality_rules.assess(none), bpe.decode(bpe.encode(none, BYTE_BPE), BYTE_BPE), packing.pack(none, WORD_BPE), minhash.dedup(none),
                  substring_dedup.dedup(none), suffix_dedup.dedup(none), toxicity.score(none, toxicity.fit(none, none.select("doc_id", none["n_words"].alias("toxic"))))):
        assert frame.collect() == []


def test_crc_of_pieces(docs):
    from pyspark.sql import functions as F

    row = packing.pack(docs, WORD_BPE).select("ids", F.crc32("ids").alias("c")).first()
    assert zlib.crc32(bytes(row["ids"])) == row["c"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def crowded(seed: int, n: int, own: int) -> list[tuple[int, str]]:
    """Texts that share 100 words and have ``own`` words each of their own."""
    r = random.Random(seed)
    shared = [f"w{r.randrange(10 ** 6)}" for _ in range(100)]
    return [(k, " ".join([*shared, *(f"v{r.randrange(10 ** 6)}" for _ in range(own))])) for k in range(n)]


@pytest.mark.parametrize(("own", "parts"), [(2, 1), (12, 3000)])
def test_minhash_rows_grow_with_members(spark, monkeypatch, own, parts):
    """3000 near copies become one component and 3000 alike but unlinked texts none; neither gives rows by pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 700)
    given, inner = [], minhash.alike

    def counted(*args, **more):
        found = inner(*args, **more)
        given.append(found.count())
        return found

    monkeypatch.setattr(minhash, "alike", counted)
    docs = spark.createDataFrame(crowded(own, 3000, own), "doc_id long, text string").repartition(8)
    found = minhash.dedup(docs).collect()
    assert len({r["component_id"] for r in found}) == parts and sum(given) <= 3000 * minhash.BANDS
