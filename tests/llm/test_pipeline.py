"""Each stage against brute force on what the stage before kept."""

import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate import brute as phrases
from test_lines_secrets import brute_lines
from test_simhash import brute_components, brute_print

import corpus_pipeline
from loctrack.llm import bytebpe, quality_rules
from loctrack.llm.common import written
from loctrack.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, quality), (_, lines), (_, near), (_, bench), (_, tokens) = corpus_pipeline.STAGES
    verdict = quality_rules.assess(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in verdict.where("kept").collect()}
    one = quality(spark, docs, SF)
    assert one.columns == docs.columns
    assert rows(one) == [r for r in rows(docs) if r[0] in kept] and 0 < len(kept) < docs.count()

    two = lines(spark, one, SF)
    assert two.columns == docs.columns
    assert rows(two) == sorted(brute_lines(rows(one)).items())
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = near(spark, two, SF)
    assert three.columns == docs.columns
    group = brute_components([brute_print(t) for _, t in rows(two)])
    first = {}
    for (doc, _), g in zip(rows(two), group, strict=True):
        first[g] = min(first.get(g, doc), doc)
    assert [d for d, _ in rows(three)] == sorted(first.values()) and len(first) < len(group)

    four = bench(spark, three, SF)
    assert four.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = rows(three)
    assert rows(four) == [r for r in texts if not phrases(r[1], items, 10)[1]] and 0 < four.count() < three.count()

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.ByteBpe.load(P.path(BYTE_BPE), P.PATTERN).ranks, special_tokens={})
    want = [(d, lib.encode_ordinary(t)) for d, t in rows(four)]
    assert sorted((r.doc_id, list(r.ids)) for r in tokens(spark, four, SF).collect()) == want
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in got.collect()) == [(d, len(i), i, hashlib.sha256(t.encode()).hexdigest()) for (d, i), (_, t) in zip(want, rows(four), strict=True)]


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null and repeated rows, a text of one very long word, and the names that
    the operators use inside, through all stages."""
    names = ["lines_before", "_id", "_kept_id", "_hit_id", "_text_hash", "doc", "key", "key_hash", "kept", "hit_id", "id", "fp", "root", "component_id", "ratio", "base_failed", "text_hash", "segment"]
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = given.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    odd = docs.limit(1).drop("doc_id", "text").crossJoin(spark.createDataFrame([(None, None), (None, ""), (None, "x" * 200_000), (5, None)], "doc_id long, text string")).select(docs.columns)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 5")).unionByName(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = written(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in now.collect()} == {tuple(range(len(names)))}
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").select(given.columns)
    for _, stage in corpus_pipeline.STAGES[:4]:
        want = written(stage(spark, want, str(tmp_path)), "test")
    assert rows(now) == rows(want) and len(rows(want)) > 30
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [d for d, _ in rows(want)]


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
