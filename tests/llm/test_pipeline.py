"""The stages on the smallest tables, each against plain Python on its own input."""

import corpus_pipeline
from test_operators import brute_components, brute_overlap

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(spark.createDataFrame((d := stage(spark, frames[-1], DATA)).collect(), d.schema))
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames[:5]]
    assert all(f.columns == docs.columns for f in frames[:5])
    assert rows[1].items() <= rows[0].items()
    assert sorted(rows[2]) == sorted(i for i, (_, c) in brute_components(rows[1].items()).items() if i == c)
    assert sorted(rows[3]) == sorted(i for i, t in rows[2].items() if not brute_overlap(t, items)[1])
    assert sorted(rows[4]) == sorted(rows[3])
    assert {r.doc_id for r in frames[5].collect()} == set(rows[4])
