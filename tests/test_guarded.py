"""Guarded changes: what is approved is applied once, whole, or not at all."""

import pytest
from pyspark.sql import functions as F

from folioflow.plans import guarded as G

def at():
    return F.to_timestamp(F.lit("2024-05-06"))


def ledger(spark, folder, **more):
    archives = [(1, "t", "cost_info", True, False), (2, "t", "cost_info", True, False), (3, "u", "cost_info", True, False), (4, "t", "quota", True, False), (5, "t", "cost_info", False, True), (6, "t", "cost_info", None, None)]
    mounts = [(10, 1, 100, "import"), (11, 1, 101, None), (12, 3, 100, "x")]
    assets = [(200, "t"), (201, "u"), (101, "t")]
    frames = {
        "archives": spark.createDataFrame(more.get("archives", archives), "archive_id long, tenant string, domain string, is_current boolean, is_withdrawn boolean").withColumn("updated_at", F.lit(None).cast("timestamp")).withColumn("title", F.lit("kept")),
        "mounts": spark.createDataFrame(mounts, "mount_id long, archive_id long, file_id long, linked_by string"), "assets": spark.createDataFrame(assets, "file_id long, tenant string"),
    }
    out = G.Ledger(spark, str(folder))
    assert out.version() == 0 and out.commit(0, frames) == 1
    return out


def plan(spark, withdraw=(), relink=()):
    return G.Plan(spark.createDataFrame(list(withdraw), "archive_id long, canonical_id long"), spark.createDataFrame(list(relink), "mount_id long, archive_id long, missing_file_id long, candidates array<long>"))


def test_applies_once_and_whole(spark, tmp_path):
    store, good = ledger(spark, tmp_path), plan(spark, [(2, 1)], [(10, 1, 100, [200])])
    assert G.apply(store, lambda now: good, good.digest(), at=at()) == 2
    rows = {r.archive_id: r for r in store.read("archives").collect()}
    assert (rows[2].is_current, rows[2].is_withdrawn, rows[2].title) == (False, True, "kept") and rows[2].updated_at == rows[1].updated_at is not None
    assert (rows[1].is_current, rows[1].is_withdrawn) == (True, False) and rows[3].updated_at is None and len(rows) == 6
    assert sorted(map(str, store.read("mounts").collect())) == sorted(map(str, spark.createDataFrame([(10, 1, 200, "catalog_cleanup_apply"), (11, 1, 101, None), (12, 3, 100, "x")], "mount_id long, archive_id long, file_id long, linked_by string").collect()))
    events, audit, outbox = (store.read(n).collect() for n in ("events", "audit", "outbox"))
    assert sorted(e.event_type for e in events) == ["ARCHIVE_FILE_ATTACHED", "ARCHIVE_WITHDRAWN"] and sorted(a.target_type for a in audit) == ["archive", "archive_file"]
    assert {o.idempotency_key for o in outbox} == {f"archive_event:{e.event_id}" for e in events}
    # what was there before can still be read, and the same plan is refused now
    assert store.read("archives", 1).where("is_withdrawn").count() == 1
    with pytest.raises(G.Refused, match="NOT_ACTIVE"):
        G.apply(store, lambda now: good, good.digest())
    more = plan(spark, [], [(12, 3, 100, [201])])
    assert G.apply(store, lambda now: more, more.digest()) == 3 and store.read("events").count() == 3


def test_drift_and_conflict(spark, tmp_path):
    store, good = ledger(spark, tmp_path), plan(spark, [(2, 1)])
    with pytest.raises(G.Refused, match="DRIFTED"):
        G.apply(store, lambda now: plan(spark, [(2, 1), (1, 2)]), good.digest())

    def late(now):
        store.commit(1, {"assets": now.assets})
        return good

    with pytest.raises(G.Conflict):
        G.apply(store, late, good.digest())
    assert store.version() == 2 and store.read("archives").where("archive_id = 2 AND is_withdrawn").count() == 0


@pytest.mark.parametrize(
    ("withdraw", "relink", "reason"),
    [
        ([(9, 1)], [], "ACTION_OR_CANONICAL_ARCHIVE_DISAPPEARED: 9"), ([(1, 9)], [], "ACTION_OR_CANONICAL_ARCHIVE_DISAPPEARED: 1"), ([(4, 1)], [], "ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO: 4"), ([(6, 1)], [], "ACTION_ARCHIVE_NOT_ACTIVE_COST_INFO: 6"),
        ([(1, 5)], [], "CANONICAL_ARCHIVE_NOT_ACTIVE: 5"), ([(3, 1)], [], "CANONICAL_ARCHIVE_TENANT_MISMATCH: 3"), ([], [(19, 1, 100, [200])], "ORPHAN_REFERENCE_DISAPPEARED: 19"), ([], [(10, 1, 100, [200, 101])], "RELINK_CANDIDATE_NOT_UNIQUE: 1"),
        ([], [(10, 1, 100, [])], "RELINK_CANDIDATE_NOT_UNIQUE: 1"), ([], [(10, 1, 100, None)], "RELINK_CANDIDATE_NOT_UNIQUE: 1"), ([], [(10, 1, 100, [999])], "RECOVERY_FILE_ASSET_DISAPPEARED: 10"), ([], [(10, 1, 102, [200])], "ORPHAN_REFERENCE_CHANGED: 10"),
        ([], [(12, 1, 100, [200])], "ORPHAN_REFERENCE_CHANGED: 12"), ([], [(10, 1, 100, [201])], "RECOVERY_FILE_ASSET_TENANT_MISMATCH: 10"), ([(2, 1), (2, 1)], [], "ACTION_REPEATED: 2"),
    ],
)
def test_conditions(spark, tmp_path_factory, withdraw, relink, reason):
    if not hasattr(test_conditions, "store"):
        test_conditions.store = ledger(spark, tmp_path_factory.mktemp("ledger"))
    found = [f"{r.reason}: {r.target_id}" for r in G.violations(test_conditions.store.tables(1), plan(spark, withdraw, relink)).collect()]
    assert reason in found


def test_digest_is_of_a_bag(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    assert G.digest(rows) == G.digest(rows.repartition(3).select("y", "x")) != G.digest(rows.distinct())
    assert G.digest(rows.limit(0)) != G.digest(rows.limit(0).select("x"))
