"""The corpus pipeline, stage by stage on its own input."""

import corpus_pipeline
from tests.llm import brute
from voxtable.sources.scratch import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, columns, counts = [n for n, _ in corpus_pipeline.STAGES], docs.columns, []
    assert names == ["toxicity", "quality_rules", "minhash", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = materialize(stage(spark, docs, FOLDER), name)
        after = docs.collect()
        counts.append(len(after))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            words = {i: brute.measures(t) for i, t in before}
            assert {r["doc_id"] for r in after} == {i for i, m in words.items() if m[0] >= 50 and 2 * m[4] <= m[0]}
        if name == "minhash":
            assert {r["doc_id"] for r in after} == {c for i, (_, c) in brute.near(before, 80).items()}
        if name == "suffix_dedup":
            left = {i: bytes(c for c, g in zip((t or "").encode(), f, strict=True) if not g).decode("utf-8", "ignore") for (i, t), f in zip(before, brute.removed_bytes(before, corpus_pipeline.PASSAGE_BYTES), strict=True)}
            assert {r["doc_id"]: r["text"] for r in after} == left and all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "packing":
            assert {r["doc_id"] for r in after} == {i for i, _ in before}
    assert counts[0] > counts[1] > counts[2] == counts[3]


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
