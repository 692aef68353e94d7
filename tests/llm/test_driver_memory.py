"""What the pipeline's stages ask of the driver."""

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import common, near_dup, toxicity


def watched(monkeypatch, module):
    """The frames that module stores from now on."""
    frames, plain = [], common.stored
    monkeypatch.setattr(module, "stored", lambda df, name: frames.append((name, df)) or plain(df, name))
    return frames


def brute(pairs):
    low = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in low:
        for a, b in pairs:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    return low


def test_components_take_no_round_for_stars_and_no_broadcast(spark, monkeypatch):
    frames = watched(monkeypatch, common)
    cases = [[], [(3, 3)], [(1, n) for n in range(2, 9)], [(n, n + 1) for n in range(40)], [(9, 1), (9, 2), (7, 2), (5, 6), (6, 5)], [(4, 2), (4, 3)], [(-(1 << 60), 5), (5, 7)]]
    for pairs in cases:
        frames.clear()
        got = common.components(spark.createDataFrame(pairs, "a long, b long"))
        assert {r.node: r.component for r in got.collect()} == brute(pairs)
        assert got.count() == len(brute(pairs))
        if pairs in cases[:3]:
            assert len(frames) == 1
        assert not any("Broadcast" in f._jdf.queryExecution().executedPlan().toString() for _, f in frames)


def test_more_links_start_from_the_components_so_far(spark):
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first, more = [(8, 3), (3, 5), (20, 21), (30, 31)], [(21, 5), (1, 30), (50, 51)]
    linked = near_dup._widened(None, links(first))
    got = near_dup._widened(linked, links(more))
    assert {r.node: r.component for r in got.collect()} == brute(first + more)


def test_sample_on_the_driver_takes_two_bytes_a_word(spark, monkeypatch):
    given, plain = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, prior: given.append(rows) or plain(rows, prior))
    texts = ["a b c", "", None, "x y", "x x z"] * 8
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    known = sorted(i for i in range(len(texts)) if toxicity.crc32(b"%d" % i) % 5)
    assert [np.asarray(ids).tolist() for ids, _ in given[0]] == [toxicity.bucket_ids(texts[i], {}) for i in known]
    assert all(ids.nbytes == 2 * len(ids) for ids, _ in given[0])
