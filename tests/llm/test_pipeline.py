"""The corpus pipeline against a one-by-one version, and the queries against their SQL."""

import collections
import os
import re

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm import mixing, quality, queries, simhash
from plumbline.llm import sentencepiece_codec as sp

SF = "/root/testdata/sf0.001"


def frames(spark, stage, rows, schema, sf=SF):
    docs = spark.createDataFrame(rows, schema)
    return stage(spark, docs, sf)


def test_stages_name_what_they_do():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_whole_run_one_by_one(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if r["text"] is not None and model.probability(quality.statistics(pa.array([r["text"]])))[0] >= quality.THRESHOLD]
    least = {}
    for r in rows:
        least[r["text"]] = min(least.get(r["text"], r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if least[r["text"]] == r["doc_id"]]
    at, sig, _ = simhash.signatures(pa.array([r["text"] for r in rows]))
    d = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in zip(*np.where(d <= simhash.RADIUS), strict=True):
        a, b = root(at[i]), root(at[j])
        if a != b:
            hi, lo = (a, b) if rows[a]["doc_id"] > rows[b]["doc_id"] else (b, a)
            group[hi] = lo
    rows = [r for k, r in enumerate(rows) if root(k) == k]
    toks = lambda t: re.findall(r"[ \t\n\r\f]*[^ \t\n\r\f]+", t)
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += len(toks(r["text"]))
    w = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in total}
    drawn = []
    for s in total:
        left = int(sum(total.values()) * w[s] / sum(w.values()))
        mine = sorted((r for r in rows if r["source"] == s and toks(r["text"])), key=lambda r: md5(f"{mixing.SEED}:{r['doc_id']}"))
        while left > 0:
            for r in mine:
                if left > 0:
                    k = len(toks(r["text"]))
                    drawn.append((r["doc_id"], r["text"] if k <= left else "".join(toks(r["text"])[:left])))
                    left -= min(k, left)
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    want = collections.Counter((i, tuple(ids)) for (i, _), ids in zip(drawn, lib.encode([t for _, t in drawn], num_threads=1), strict=True))
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.round_trip for r in got) and len(got) > 20


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_nulls_empties_and_ties(spark):
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "src0", 0), (None, "The men went on to the river and came back again.", "en", None, 49), (3, "The men went on to the river and came back again.", "en", "src1", 49), (3, "The men went on to the river and came back again.", "en", "src1", 49), (4, "word " * 100_000, "en", "src1", 500_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ids", "'x' AS _key", "2 AS key", "3 AS first")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == d.columns, name


def connect():
    con = duckdb.connect()
    for t in "documents labels pages conversations".split():
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    a = queries.QUERIES[name](spark, SF).toPandas()
    b = connect().execute(queries.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x, y = (sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: int(v) if isinstance(v, float) and v.is_integer() else v).values.tolist())) for d in (a, b))
    assert x == y


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "token_shards") == list(range(1, 11))


@pytest.mark.parametrize("name", ["op1_simhash_near_dedup", "op2_token_output", "op5_quality_classifier", "op7_sentencepiece", "op10_document_fingerprints"])
def test_queries_run_over_whole_tables(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = queries.QUERIES[name](spark, SF).count()
    assert rows == n if name in ("op5_quality_classifier", "op7_sentencepiece", "op10_document_fingerprints") else rows > 0
