"""Documents' states as a stream against the same in a batch."""

import datetime
import random

from pyspark.sql import functions as F

from paperloom.streaming import rollups, status

SCHEMA = "doc_id long, seq long, status string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_stream_settles_as_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.STATE_STORE)
    rng = random.Random(6)
    rows = [(d, 10 * d + n, rng.choice(["uploaded", "ocr_done", "structured", "decided"]), at(rng.randrange(0, 400))) for d in range(12) for n in range(4)]
    rows += [(50, 1, "uploaded", at(5)), (50, 2, "decided", at(5)), (51, 1, "decided", at(9)), (51, 2, "uploaded", at(1))]  # a tie, and one that is late
    rng.shuffle(rows)
    rows.append((99, 0, "uploaded", at(2000)))  # event time goes on
    source = f"{tmp_path}/in"
    stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
    put = status.keep(f"{tmp_path}/kept")
    batches = []

    def both(batch, number):
        put(batch, number)
        put(batch, number)  # as after a failure: the batch is replayed
        batches.append(number)

    spark.createDataFrame([], SCHEMA).write.parquet(f"{source}/part=none")
    query = status.statuses(stream, late="10 hours").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(both).start()
    for n in range(0, len(rows), 18):
        spark.createDataFrame(rows[n : n + 18], SCHEMA).coalesce(1).write.parquet(f"{source}/part={n}")
        query.processAllAvailable()
    spark.createDataFrame([(98, 0, "uploaded", at(4000))], SCHEMA).coalesce(1).write.parquet(f"{source}/part=last")
    query.processAllAvailable()
    query.stop()
    rows.append((98, 0, "uploaded", at(4000)))
    want = status.in_batch(spark.createDataFrame(rows, SCHEMA), F.lit(at(4000 - 600)))
    found = {r.doc_id: (r.status, r.since, r.stuck) for r in status.current(spark, f"{tmp_path}/kept").collect()}
    assert found == {r.doc_id: (r.status, r.since, r.stuck) for r in want.collect()}
    assert found[50] == ("decided", at(5), False) and found[51][0] == "decided" and found[99][2] and not found[98][2]
    assert any(s for _, _, s in found.values()) and len(batches) >= 3


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    rows = [(1, 1, "a", at(0)), (1, 1, "a", at(0)), (2, 2, "b", at(1))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rollups.drop_repeats(rollups.events(spark, f"{tmp_path}/in", SCHEMA), "seq")
    query = stream.writeStream.format("memory").queryName("repeats").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.seq for r in spark.table("repeats").collect()) == [1, 2]
