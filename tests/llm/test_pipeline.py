import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import lines, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_each_decision(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[-1] > 0
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                up[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage is given and returns, as rows."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs.collect())
    return out


def test_classifier_stage(spark, stages):
    model = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = lambda t: model.score(quality.features(t), np.array([0]))[0]
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0] if score(r["text"]) >= 0.3}


def test_line_stage_against_all_pairs(stages):
    given = [(r["doc_id"], i, x) for r in sorted(stages[1], key=lambda r: r["doc_id"]) for i, x in enumerate((r["text"] or "").split("\n"))]
    keyed = [(d, i, x.lower().strip(" ")) for d, i, x in given]
    texts = list(dict.fromkeys(x for _, _, x in keyed if x))
    sets = [lines.shingles(x) for x in texts]
    alike = lambda i, j: min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    of = dict(zip(texts, classes(len(texts), alike), strict=True))
    seen, want = set(), set()
    for d, i, x in keyed:
        if x and of[x] in seen:
            want.add((d, i))
        elif x:
            seen.add(of[x])
    kept = {r["doc_id"]: (r["text"] or "").split("\n") for r in stages[2]}
    right = [d for d in {d for d, _, _ in given} if kept.get(d, [""]) == ([x for e, i, x in given if e == d and (d, i) not in want] or [""])]
    assert want and len(right) >= 0.98 * len(stages[1])


def test_near_copy_stage_against_all_pairs(stages):
    docs = sorted(stages[2], key=lambda r: r["doc_id"])
    sets = [simhash._shingles(r["text"] or "", 5) for r in docs]
    part = classes(len(docs), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert {r["doc_id"] for r in stages[3]} == {docs[i]["doc_id"] for i in {part.index(p) for p in part}}


def test_decontamination_stage_against_brute_force(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + m]) in windows for m in sizes for i in range(len(w) - m + 1))
    assert {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3] if not hit(words(r["text"]))} != {r["doc_id"] for r in stages[3]}


def test_encoding_stage_against_the_library(stages):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in stages[4]}
    assert len(stages[5]) == len(texts)
    for r in stages[5]:
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 60000, "en", "s", 300000), (4, "x", None, None, 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema).withColumn("key", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("part", F.lit(2))
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(rows) and (rows or out.count() == 0)
