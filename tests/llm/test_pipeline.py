"""Each stage against a brute-force version over its own input."""


import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, common, queries, toxicity
from tests.llm.test_operators import SF, brute_components, brute_scan


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontamination", "bpe"]
    docs = common.table(spark, SF, "documents").withColumn("extra", F.lit(1)).withColumn("id", F.lit("x"))
    junk = spark.createDataFrame([(-1, "12 34 !!"), (-2, None)], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "text")])
    docs = docs.unionByName(junk)
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, SF)
    assert one.columns == docs.columns and one.where("doc_id < 0").count() == 0 and one.count() == docs.count() - 2
    two = common.materialise(stage["toxicity"](spark, one, SF), "two")
    model = toxicity.fit(one, common.table(spark, SF, "labels"))
    want = {r["doc_id"] for r in one.collect() if model.predict(r["text"])[1] < 0.5}
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == want and len(want) < one.count()
    three = common.materialise(stage["near_dedup"](spark, two, SF), "three")
    roots = brute_components([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80)
    assert three.columns == docs.columns and sorted(r["doc_id"] for r in three.collect()) == sorted(i for i, (_, c) in roots.items() if i == c)
    four = common.materialise(stage["decontamination"](spark, three, SF), "four")
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect() if not brute_scan(r["text"], items)[2]}
    five = {r["doc_id"]: r["n_tokens"] for r in stage["bpe"](spark, four, SF).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert five == {r["doc_id"]: len(enc.encode_ordinary(r["text"])) for r in four.collect()}


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted([f"op{i}" for i in range(1, 11)] + ["pipeline"])
    empty = common.table(spark, SF, "documents").where("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0


def test_queries_match_their_sql(spark):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, (tuple(r[x] for x in cols) for r in got.collect()))) == sorted(map(str, want)), name
