"""The replay of stream_append is the whole table."""

from tallyweave.plans import reconcile, registry
from tallyweave.streaming import incremental


def test_all_events_arrive_twice(spark, data, monkeypatch):
    arrived, changes = [], incremental.changes

    def counted(session, folder, *more):
        arrived.append(session.read.parquet(folder).count())
        return changes(session, folder, *more)

    monkeypatch.setattr(incremental, "changes", counted)
    got = reconcile.QUERIES["stream_append"](spark, data)
    events = spark.read.parquet(f"{data}/events.parquet")
    n = events.count()
    assert arrived == [n, 2 * n]
    assert got.count() == n and not got.exceptAll(events).count()
    assert "stream_append" in registry.ORACLE_SQL
