"""State by key against plain loops: folds cut anywhere, nulls, late and repeated events."""

from datetime import datetime, timedelta

from dyadlake.streaming import events as E
from dyadlake.streaming import keyed as K


def test_folds_cut_anywhere():
    values = [3, None, 4, 1, None, 5, 9, 2, 6]
    sums = [sum(v or 0 for v in values[max(0, i - 2) : i + 1]) for i in range(len(values))]
    lasts = [next((v for v in reversed(values[:i]) if v is not None), None) for i in range(len(values))]
    for cut in range(len(values) + 1):
        for fold, want in ((K.rolling_sum(3), sums), (K.last_before, lasts)):
            a, past = fold([], values[:cut])
            b, _ = fold(past, values[cut:])
            assert a + b == want


def test_a_window_of_one_keeps_nothing():
    assert K.rolling_sum(1)([], [3, None, 4]) == ([3, 0, 4], [])


def test_silent_keys_are_forgotten(spark, tmp_path):
    """A key's sum starts anew after a silence of more than ``keep``, in whatever part the events come; forgotten keys leave no rows of state."""
    t, keep = datetime(2024, 1, 1), 10 * 3600 * 1000
    rows = [(t + timedelta(hours=h), i, u, 1) for i, (h, u) in enumerate([(0, 1), (1, 1), (5, 1), (20, 1), (21, 1), (21, 2), (60, 9), (61, 1), (100, 9), (200, 9)])]
    schema = "ts timestamp, event_id long, user_id long, value long"
    want = {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1}  # the last still waits
    for cuts in ((10,), (2, 5, 7, 10), (3, 6, 9, 10)):
        parts = [spark.createDataFrame(rows[a:b], schema) for a, b in zip((0, *cuts), cuts, strict=False)]
        found = E.arrivals(spark, parts, lambda s: K.in_order(s, "user_id", "value", K.rolling_sum(5), "rolled", keep))
        assert {r.event_id: r.rolled for r in found.collect()} == want
    many = [(t + timedelta(hours=h), h, h, 1) for h in range(300)]  # a new key every hour
    state = []
    for k in range(4):
        spark.createDataFrame(many[k * 75 : k * 75 + 75], schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = K.in_order(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user_id", "value", K.rolling_sum(5), "rolled", keep)
        q = q.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
        state.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert max(state) < 200  # what waits and the keys of the last ten hours, with their timers; all 300 keys and theirs would be 600


def test_in_order_over_parts(spark):
    """Events come in disorder within and over parts; one is later than the watermark allows, one has a null value, one a null key."""
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=m), i, u, v) for m, i, u, v in [(100, 1, 7, 10), (0, 2, 7, 1), (300, 3, 7, 100), (250, 4, 7, None), (10, 5, 7, 5), (260, 6, 7, 1000), (900, 7, 8, 1), (10, 8, None, 2)]]
    schema = "ts timestamp, event_id long, user_id long, value long"
    parts = [spark.createDataFrame([rows[i] for i in part], schema) for part in ([0, 1, 7], [2], [3, 4, 5, 6])]
    found = E.arrivals(spark, parts, lambda s: K.in_order(s, "user_id", "value", K.rolling_sum(3), "rolled")).collect()
    # event 5 (minute 10) comes after the watermark has reached minute 180; event 7 waits for a later watermark
    assert {(r.user_id, r.event_id, r.rolled) for r in found} == {(7, 2, 1), (7, 1, 11), (7, 4, 11), (7, 6, 1010), (7, 3, 1100), (None, 8, 2)}
    assert len(found) == 6


def test_empty_stream(spark):
    none = spark.createDataFrame([], "ts timestamp, event_id long, user_id long, value long")
    assert E.arrivals(spark, [none, none], lambda s: K.in_order(s, "user_id", "value", K.last_before, "last")).count() == 0
