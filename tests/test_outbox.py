"""The outbox: retries, dead letters, stale claims, deliveries that are repeated after a crash."""

import pytest

from memlake.streaming import outbox

POLICY = outbox.Policy(batch=3, stale_s=50, base_s=10, most_s=30, attempts=3, keep_sent_s=1000, keep_dead_s=2000)


def put(spark, box, ids, now=0):
    box.put(spark.createDataFrame([(i, f"p{i}", i) for i in ids], "event_id long, payload string, created_s long"), now)


def receiver(spark, sink, status, die=None):
    """Keeps a batch under its number; status(id, attempts) is its answer."""

    def deliver(rows, number):
        got = rows.collect()
        said = [(r["event_id"], status(r["event_id"], r["attempts"]), None) for r in got]
        taken = [(i,) for i, s, _ in said if s == 200]
        spark.createDataFrame(taken, "event_id long").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if die and die.pop():
            raise RuntimeError("died after delivery")
        return spark.createDataFrame(said, "event_id long, status int, retry_after_s long")

    return deliver


def states(box):
    return {r["event_id"]: (r["state"], r["attempts"], r["error"]) for r in box.table().collect()}


def delivered(spark, sink):
    return sorted(r["event_id"] for r in spark.read.schema("event_id long").parquet(sink).collect())


def test_a_receiver_that_fails_twice_gets_each_row_once(spark, tmp_path):
    box = outbox.Outbox(spark, f"{tmp_path}/box", POLICY)
    put(spark, box, range(5))
    put(spark, box, [3, 4])  # known
    r = receiver(spark, f"{tmp_path}/sink", lambda i, n: 200 if n == 2 or i == 0 else 503)
    ticks = [box.tick(r, now) for now in range(0, 100, 5)]
    assert delivered(spark, f"{tmp_path}/sink") == list(range(5))
    assert states(box) == {0: ("sent", 0, None), **{i: ("sent", 2, None) for i in range(1, 5)}}
    assert ticks[-1] == 0 and max(ticks) >= 4


def test_backoff_limits_and_refusals(spark, tmp_path):
    box = outbox.Outbox(spark, f"{tmp_path}/box", POLICY)
    put(spark, box, [1, 2, 3])
    box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: {1: None, 2: 422, 3: 403}[i]), 0)
    assert states(box) == {1: ("pending", 1, "network_error"), 2: ("dead_letter", 0, "http_422"), 3: ("pending", 1, "auth_403")}
    assert {r["event_id"]: r["next_s"] for r in box.table().collect() if r["state"] == "pending"} == {1: 10, 3: 30}
    assert box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: 500), 9) == 0
    box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: 500), 10)
    assert box.table().where("event_id = 1").first()["next_s"] == 30
    box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: 500), 30)
    assert states(box)[1] == ("dead_letter", 2, "http_500") and states(box)[3] == ("pending", 2, "http_500")
    h = outbox.health(box.table(), 400).first()
    assert (h["pending"], h["dead"], h["oldest_s"], h["status"]) == (1, 2, 397, "degraded")
    box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: 200), 1000)
    box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: 200), 1001)
    put(spark, box, [9], 3100)
    box.tick(receiver(spark, f"{tmp_path}/s", lambda i, n: 200), 3100)
    assert set(states(box)) == {9}


def test_a_batch_is_delivered_again_under_its_number(spark, tmp_path):
    box = outbox.Outbox(spark, f"{tmp_path}/box", POLICY)
    put(spark, box, range(3))
    with pytest.raises(RuntimeError, match="died"):
        box.tick(receiver(spark, f"{tmp_path}/sink", lambda i, n: 200, [True]), 0)
    assert {s for s, _, _ in states(box).values()} == {"claimed"}
    again = outbox.Outbox(spark, f"{tmp_path}/box", POLICY)
    assert again.tick(receiver(spark, f"{tmp_path}/sink", lambda i, n: 200), 1) == 1
    assert delivered(spark, f"{tmp_path}/sink") == [0, 1, 2]


def test_a_stale_claim_is_taken_over(spark, tmp_path):
    box = outbox.Outbox(spark, f"{tmp_path}/box", POLICY)
    put(spark, box, range(3))
    box._write(outbox.claim(box.table(), 1, 0, POLICY))
    with pytest.raises(RuntimeError):
        box.tick(lambda rows, number: (_ for _ in ()).throw(RuntimeError(number)), 50)
    assert box.tick(receiver(spark, f"{tmp_path}/sink", lambda i, n: 200), 51) == 2
    assert delivered(spark, f"{tmp_path}/sink") == [0, 1, 2]
