"""The status job as polls land, against all polls at once."""

import json

from pollweave.plans import publishing, reconcile as rec
from pollweave.plans import status as st
from pollweave.plans.translation import owned_columns
from pollweave.sources import documents as docs, state
from pollweave.streaming import jobs, status as job
from test_status import P1, P2, P3, put_aggregate, put_primary, put_rest, sources


def documents(spark, folder):
    rows = spark.read.text(f"{folder}/documents").collect()
    return {r["poll_ts"]: json.loads(r["value"]) for r in rows}


def test_state_of_polls_that_were_settled_again_is_not_used(spark, tmp_path):
    folder = str(tmp_path)
    batches = {0: (0, 10), 1: (11, 20), 2: (21, 30), 3: (15, 30)}  # batch 3 redid 15 to 30
    for batch, (since, newest) in batches.items():
        log = spark.createDataFrame([(since, newest)], "since bigint, newest bigint")
        state.save(log, f"{folder}/log", batch)
    assert job._resume(spark, folder, 31, 4) == (31, 3)
    assert job._resume(spark, folder, 25, 4) == (11, 0)  # batch 1 ends inside what was redone
    assert job._resume(spark, folder, 25, 3) == (21, 1)
    assert job._resume(spark, folder, 5, 4) == (0, -1)


def test_polls_are_settled_as_they_land(spark, landing, tmp_path):
    folder = str(tmp_path / "job")

    def run():
        jobs.finish(job.start(spark, landing.folder, folder, refresh=None))

    landing.put("news", P1, [])
    run()  # nothing is complete yet: nothing is published
    put_primary(landing, P1)
    put_aggregate(landing, P1)
    put_rest(landing, P1)
    put_primary(landing, P3, assignment=[])
    landing.put("series", P1, {"data": [{"timestampUtc": "t1", "totalPlayerCount": 4}]})
    landing.put("translated", P1, {"mo_brief": {"title": "M"}, "items": [{"id": 1}]})
    run()
    assert sorted(documents(spark, f"{folder}/out")) == [P1, P3]
    put_primary(landing, P2, assignment=[])  # lands late
    put_aggregate(landing, P2, majorOrders=[{"id32": 99}])
    run()

    status = rec.reconcile(*sources(spark, landing))
    translations = docs.read_documents(spark, f"{landing.folder}/translated", docs.TRANSLATIONS)
    owned = owned_columns(status.polls, translations)
    whole = str(tmp_path / "whole")
    publishing.publish_documents(status, whole, st.read_series(spark, landing.folder), owned)
    found = documents(spark, f"{folder}/out")
    assert sorted(found) == [P1, P2, P3]
    assert found[P3]["assignments"]["id"] == 99
    assert found == documents(spark, whole)
    # What the translator wrote for the first poll stays in the later ones.
    assert {d["major_order"]["title"] for d in found.values()} == {"M"}
    newest = state.versions(spark, f"{folder}/history")[-1]
    kept = spark.read.parquet(f"{folder}/history/{state.VERSION}={newest}")
    assert [r["timestamp"] for r in kept.collect()] == ["t1"]
