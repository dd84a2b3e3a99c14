import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as p
from strata.llm import byte_bpe, decontaminate, queries

D = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    from test_jaccard import brute  # the same all-pairs check

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, docs
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, kept, D)
        out.write.parquet(f"{tmp_path}/{i}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or kept.columns == columns
        if i == 2:
            want = brute([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
        if i == 3:
            bench = spark.read.parquet(f"{D}/benchmark.parquet")
            assert decontaminate.digest(decontaminate.find_spans(kept, bench)).where("contaminated").count() == 0
    texts = {r.doc_id: r.text for r in before.collect()}
    ranks = byte_bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = kept.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids, np.uint32).tolist() == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_run_is_the_stages(spark):
    assert p.run(spark, D).count() > 100


def test_odd_rows_at_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns of names that the stages use."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    text, item = docs.where("lang = 'en'").first().text, spark.read.parquet(f"{D}/benchmark.parquet").first().text
    long = " ".join([text] * (1_000_000 // len(text)))
    odd = [(-1, None, None, None, None), (-2, "", "en", "x", 0), (-3, "12 !!", "en", "x", 5), (-4, long, "en", "x", len(long)), (-5, item, "en", "x", 9), (None, text + " again and again", None, None, None), (-6, long, "en", "x", 3), (-6, long, "en", "x", 3)]
    clash = ["perturbed", "spans", "row", "ids", "k", "t", "sid", "salt"]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", *[f"doc_id as {c}" for c in clash])
    left = {}
    for name, stage in p.STAGES:
        out = stage(spark, every, D)
        left[name] = sorted(r.doc_id or 0 for r in out.where("doc_id < 0 or doc_id is null").collect())
        assert out.columns == (every.columns if name != "byte-level BPE" else ["doc_id", "n_tokens", "ids", "decoded"])
        assert stage(spark, every.limit(0), D).count() == 0
    assert left["language ID"] == [-6, -6, -5, -4, 0]
    assert left["quality classifier"].count(-6) in (0, 2)
    assert left["n-gram Jaccard join"] == [-6, -5, -3, -2, -1, 0]
    assert left["benchmark decontamination"] == [-6, -6, -4, -3, -2, -1, 0]
    assert left["byte-level BPE"] == [-6, -6, -5, -4, -3, -2, -1, 0]
