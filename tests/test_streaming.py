"""Streams against tables: the same rows in micro-batches give the same result."""

from datetime import datetime, timedelta

from metaloom.streaming import activity
from pyspark.sql import functions as F

BEGIN = datetime(2024, 1, 1)


def at(minutes):
    return BEGIN + timedelta(minutes=minutes)


def test_sessions_of_a_stream_equal_those_of_the_table(spark):
    rows = [(u, at(m), v) for u, m, v in [(1, 0, 5), (1, 20, 1), (1, 60, 2), (2, 5, 7), (1, 75, 1), (2, 200, 3), (2, 210, 4), (3, 300, 1)]]
    table = spark.createDataFrame([*rows, (99, at(5000), 0)], "user int, ts timestamp, value int")
    whole = activity.sessions(table.where("user <> 99"), "user", "ts", total=F.col("value"))
    stream = activity.sessions(activity.replayed(table, "ts", 4), "user", "ts", total=F.col("value"))
    found, query = activity.drained(stream)
    assert sorted(map(tuple, found.drop("_batch").collect())) == sorted(map(tuple, whole.collect()))  # but for 99, whose session stays open
    assert found.select("_batch").distinct().count() > 1 and activity.late_rows(query) == 0
    assert [tuple(r)[3:] for r in whole.orderBy("user", "first").collect()] == [(2, 6), (2, 3), (1, 7), (2, 7), (1, 1)]


def test_late_rows_are_counted(spark, tmp_path):
    for rows in ([(1, at(0))], [(1, at(1000))], [(1, at(1001))], [(1, at(1)), (1, at(990))]):
        spark.createDataFrame(rows, "user int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found, query = activity.drained(activity.sessions(stream, "user", "ts"))
    assert [(r.n, r["first"]) for r in found.collect()] == [(1, at(0))] and activity.late_rows(query) == 1


def test_last_seen_state(spark):
    rows = [("a", at(0), "x"), ("a", at(10), "x"), ("a", at(20), "y"), ("b", at(5), "q"), ("a", at(100), "x"), ("b", at(110), "q"), (None, at(1), "n"), ("c", at(4000), "z"), ("a", at(4100), "w")]
    table = spark.createDataFrame(rows, "url string, ts timestamp, html string")
    found, _ = activity.drained(activity.last_seen(activity.replayed(table, "ts", 3), "ts", "html", forget_ms=10**12), rocks=True)
    last = found.groupBy("url").agg(F.max_by(F.struct("first", "last", "times", "changes"), "times").alias("x"))
    assert {r.url: tuple(r.x) for r in last.collect()} == {"a": (at(0), at(4100), 5, 3), "b": (at(5), at(110), 2, 0), "c": (at(4000), at(4000), 1, 0)}
    # A URL that is forgotten begins anew.
    more = spark.createDataFrame([("a", at(0), "x"), ("b", at(1000), "x"), ("b", at(2000), "x"), ("b", at(3000), "x"), ("a", at(4000), "x")], table.schema)
    found, _ = activity.drained(activity.last_seen(activity.replayed(more, "ts", 5), "ts", "html", forget_ms=60_000), rocks=True)
    assert [(r["first"], r.times) for r in found.where("url = 'a'").orderBy("_batch").collect()] == [(at(0), 1), (at(4000), 1)]


def test_documents_meet_their_pages_and_others_stay_alone(spark):
    links = spark.createDataFrame([(1, "/a", at(0)), (2, "/b", at(1)), (3, "/a", at(200)), (4, None, at(3)), (9, "/end", at(5000))], "page_id int, href string, asked timestamp")
    docs = spark.createDataFrame([("/a", "A", at(10)), ("/a", "late", at(90)), ("/b", "early", at(0)), ("/a", "again", at(210)), ("/end", "e", at(5001)), ("/z", "z", at(6000))], "doc_href string, body string, got timestamp")
    stream = activity.documents_of_pages(activity.replayed(links, "asked", 3), activity.replayed(docs, "got", 3))
    found, _ = activity.drained(stream)
    got = sorted((r.page_id, r.body) for r in found.collect())
    assert got == [(1, "A"), (2, None), (3, "again"), (4, None), (9, "e")]
    batch_of = {r.page_id: r._batch for r in found.collect()}
    assert batch_of[2] > batch_of[1]  # known to be alone only after the watermark


def test_documents_of_no_page_move_the_time_on(spark):
    links = spark.createDataFrame([(1, "/a", at(0)), (2, "/b", at(5)), (3, None, at(6)), (9, None, at(5000))], "page_id int, href string, asked timestamp")
    docs = spark.createDataFrame([("/a", "A", at(1)), (None, "nobody's", at(6)), (None, "end", at(5000))], "doc_href string, body string, got timestamp")
    found, _ = activity.drained(activity.documents_of_pages(activity.replayed(links, "asked", 2), activity.replayed(docs, "got", 2)))
    assert found.columns == ["page_id", "href", "asked", "doc_href", "body", "got", "_batch"]
    assert sorted((r.page_id, r.body) for r in found.where("page_id < 9").collect()) == [(1, "A"), (2, None), (3, None)]
