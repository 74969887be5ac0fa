"""The pipeline's stages, each against what plain Python makes of its own input."""

import collections
import re

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"][1].collect()}
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    best = collections.defaultdict(int)
    for r in seen["exact_dedup"][0].collect():
        best[low(r["text"])] = max(best[low(r["text"])], r["doc_id"])
    assert sorted(r["doc_id"] for r in seen["exact_dedup"][1].collect()) == sorted(best.values())
    from test_text_operators import brute_components

    rows = sorted(seen["ngram_join"][0].collect(), key=lambda r: r["doc_id"])
    want = [rows[i]["doc_id"] for i, (n, c) in brute_components([r["text"] for r in rows]).items() if not n or c == i]
    assert sorted(r["doc_id"] for r in seen["ngram_join"][1].collect()) == want
    n = lambda df: sum(len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in df.collect())
    assert abs(n(seen["mixing"][1]) - n(seen["mixing"][0])) <= 20
    tokens = collections.defaultdict(int)
    for r in docs.collect():
        tokens[r["sequence_id"]] += r["length"]
    assert sum(v != 1024 for v in tokens.values()) <= 1
