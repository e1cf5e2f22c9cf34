"""The status job on a refresh interval: settle polls as their documents land."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from pollweave.functions import fixed
from pollweave.plans import publishing, reconcile as rec
from pollweave.plans import status as st
from pollweave.operators import history
from pollweave.plans.translation import OWNED, owned_columns
from pollweave.session import run_folder
from pollweave.sources import documents as docs, state
from pollweave.sources.documents import POLL
from pollweave.streaming import jobs

_LOG = "since bigint, newest bigint"


def start(spark: SparkSession, landing: str, folder: str, refresh: str | None = fixed.REFRESH):
    """Settle what landed; ``refresh=None`` runs once over what is there.

    A document that lands late settles its poll and all later ones again, so the result
    does not depend on the order of arrival.
    """

    def each_batch(rows, batch_id: int) -> None:
        oldest = rows.agg(F.min(POLL)).first()[0]
        if oldest is not None:
            settle(rows.sparkSession, landing, folder, oldest, batch_id)

    return jobs.start(docs.stream_arrivals(spark, landing), folder, "append", each_batch, refresh)


def settle(
    spark: SparkSession, landing: str, folder: str, oldest: int, batch_id: int,
    documents: bool = True,
) -> None:
    """Settle and publish all polls from ``oldest`` on, with the state of the polls before.

    ``documents`` also writes each poll as one document. Nothing happens while no source has a complete poll; the missing document starts
    another batch when it lands.
    """
    since, version = _resume(spark, folder, oldest, batch_id)
    carried = rec.load_carried(spark, f"{folder}/state", version + 1)
    work = run_folder(spark, "status")
    read = (st.read_primary, st.read_aggregate, st.read_rest)
    try:
        status = rec.reconcile(*[f(spark, landing, work, since) for f in read], carried)
    except rec.NoSource:
        return
    translations = docs.read_documents(spark, f"{landing}/translated", docs.TRANSLATIONS, since)
    series = st.read_series(spark, landing, since)
    before = state.load_before(spark, f"{folder}/state/owned", OWNED, version + 1)
    owned = owned_columns(status.polls, translations, before)
    records = history.first_per_key(series, ["timestamp"], [F.col(POLL)]).drop(POLL)
    state.append_history(
        spark, f"{folder}/history", records, ["timestamp"], [F.desc("timestamp")], batch_id)
    publishing.publish(status, f"{folder}/out", series, owned)
    if documents:
        publishing.publish_documents(status, f"{folder}/out", series, owned)
    rec.save_carried(rec.carry_over(status, carried), f"{folder}/state", batch_id)
    state.save(history.newest(owned, [F.desc(POLL)], 1), f"{folder}/state/owned", batch_id)
    newest = status.polls.agg(F.max(POLL)).first()[0]
    state.save(spark.createDataFrame([(since, newest)], _LOG), f"{folder}/log", batch_id)


def _resume(spark: SparkSession, folder: str, oldest: int, batch_id: int) -> tuple[int, int]:
    """The first poll to settle, and the batch whose state holds the polls before it.

    A state is of use if it ends before ``oldest`` and no later batch settled its polls
    again. The log has one short row per batch.
    """
    log = state.load_all(spark, f"{folder}/log", _LOG).where(F.col(state.VERSION) < batch_id)
    later = Window.orderBy(F.desc(state.VERSION)).rowsBetween(Window.unboundedPreceding, -1)
    redone = log.withColumn("redone_from", F.min("since").over(later))
    usable = redone.where(F.col("newest") < F.least(F.lit(oldest), F.col("redone_from")))
    best = usable.orderBy(F.desc(state.VERSION)).first()
    return (best["newest"] + 1, best[state.VERSION]) if best else (0, -1)
