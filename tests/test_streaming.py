import gzip
import os
from datetime import date

from pyspark.sql import functions as F

from opslens.functions.times import DAY, HOUR, MINUTE
from opslens.operators import inbound, lb, orders, rules, sessions, state
from opslens.operators.lb import RequestQuery
from opslens.sources import writers
from opslens.streaming import alerts, convert, generations, sightings
from opslens.streaming import inbound as inbound_stream
from opslens.streaming import sessions as session_stream
from test_alerts import BASE, FINDING, checks_of_instances, values
from test_sessions_health import ENTRY

ONCE = {"availableNow": True}
T0 = 1_791_352_800_000                    # 2026-10-07T06:00Z


def write_log(folder, name, times, code=200):
    lines = [f'https {t} app/elb-x/1 1.2.3.4:5 10.0.0.1:80 0.0 0.1 0.0 {code} {code} 1 2 "GET https://h/a/1 HTTP/1.1" "ua" - - '
             f'arn:x:targetgroup/tg-a/1 "Root={name}-{i}" "h"' for i, t in enumerate(times)]
    with gzip.open(os.path.join(folder, name + ".log.gz"), "wt") as out:
        out.write("\n".join(lines) + "\n")


def test_files_are_converted_once_and_late_ones_merge_the_hour_again(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = convert.RequestStore(str(tmp_path / "store"))

    def run(now):
        convert.stream_convert(spark, str(logs), store, str(tmp_path / "checkpoint"), now, ONCE).awaitTermination()
        tables = store.tables(spark)
        total = lb.status_totals(RequestQuery(T0, T0 + DAY).minutes(tables)).first()
        return total.requests, tables.requests.count(), 0 if tables.unmerged is None else tables.unmerged.count()
    write_log(logs, "a", ["2026-10-07T06:10:00.5Z", "2026-10-07T06:59:59Z", "2026-10-07T07:00:01Z"])
    assert run(T0 + 70 * MINUTE) == (3, 0, 3)                    # not settled: nothing merged yet
    write_log(logs, "b", ["2026-10-07T07:01:00Z"], 500)
    assert run(T0 + 80 * MINUTE) == (4, 2, 2)                    # the first hour is merged
    assert run(T0 + 80 * MINUTE) == (4, 2, 2)                    # nothing new: nothing counted twice
    write_log(logs, "late", ["2026-10-07T06:30:00Z"])
    assert run(T0 + 90 * MINUTE) == (5, 3, 2)                    # the whole hour again
    write_log(logs, "c", ["2026-10-07T07:50:00Z"])
    assert run(T0 + 140 * MINUTE) == (6, 6, 0)
    tables = store.tables(spark)
    assert tables.minutes.agg(F.sum("n")).first()[0] == tables.paths.agg(F.sum("n")).first()[0] == 6
    ledger = store.read(spark, "ledger")
    assert ledger.select("path").distinct().count() == ledger.count() == 4
    # a batch that is repeated after a failure replaces itself
    rows = spark.read.text(str(logs / "c.log.gz")).select(F.col("value").alias("raw"), F.lit("c").alias("file"))
    for _ in range(2):
        store.add(rows, 77)
    assert store.unmerged(spark).count() == 1


def test_a_range_is_converted_once_and_in_any_order(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store, now = convert.RequestStore(str(tmp_path / "store")), T0 + DAY
    write_log(logs, "a", ["2026-10-07T06:10:00Z", "2026-10-07T06:20:00Z"])

    def total():
        tables = store.tables(spark)
        return lb.status_totals(RequestQuery(T0, T0 + DAY).minutes(tables)).first().requests, tables.requests.count(), tables.unmerged.count()
    assert convert.convert_range(spark, [str(logs)], store, now) == 1
    assert convert.convert_range(spark, [str(logs)], store, now) == 0 and total() == (2, 2, 0)
    write_log(logs, "b", ["2026-10-07T06:30:00Z"])
    convert.stream_convert(spark, str(logs), store, str(tmp_path / "one"), now, ONCE).awaitTermination()
    assert total() == (3, 3, 0)                                  # the stream finds "a" in the ledger
    convert.stream_convert(spark, str(logs), store, str(tmp_path / "two"), now, ONCE).awaitTermination()
    assert convert.convert_range(spark, [str(logs)], store, now) == 0 and total() == (3, 3, 0)
    # a crash before the marker leaves the old version in sight
    rows = spark.read.text(str(logs / "b.log.gz")).select(F.col("value").alias("raw"), F.lit("late").alias("file"))
    store.add(rows, store.batch_of(spark, "late"))
    assert total() == (4, 3, 1)
    store.merge(spark, now, store.batch_of(spark, "late"))
    assert total() == (4, 4, 0) and store.batch_of(spark, "late") == store.batch_of(spark, "late")


def test_a_broken_file_waits_and_the_others_go_on(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store, start = convert.RequestStore(str(tmp_path / "store")), T0 + DAY
    for i in range(10):
        write_log(logs, f"f{i}", [f"2026-10-07T0{6 + i % 3}:10:0{i}Z"] * 40)
    whole = (logs / "f4.log.gz").read_bytes()
    (logs / "f4.log.gz").write_bytes(whole[:60])
    with gzip.open(logs / "blank.log.gz", "wt") as out:
        out.write("\n")

    def run(now):
        convert.stream_convert(spark, str(logs), store, str(tmp_path / "checkpoint"), now, ONCE).awaitTermination()
        return lb.status_totals(RequestQuery(T0, T0 + DAY).minutes(store.tables(spark))).first().requests
    assert run(start) == 360
    failed = store.failures(spark).collect()
    assert [(r.path.rsplit("/", 1)[1], r.tries, r.next_ms) for r in failed] == [("f4.log.gz", 1, start + 30 * MINUTE)] and failed[0].error
    assert store.read(spark, "ledger").count() == 10            # a file without a line counts as converted
    assert convert.convert_range(spark, [str(logs)], store, start) == 0
    assert convert.retry_failed(spark, store, start + 29 * MINUTE) == 0
    assert convert.retry_failed(spark, store, start + 31 * MINUTE) == 0     # still broken
    assert [(r.tries, r.next_ms) for r in store.failures(spark).collect()] == [(2, start + 61 * MINUTE)]
    (logs / "f4.log.gz").write_bytes(whole)
    write_log(logs, "new", ["2026-10-07T09:10:00Z"])
    assert run(start + 40 * MINUTE) == 361 and store.failures(spark).count() == 1
    write_log(logs, "newer", ["2026-10-07T09:11:00Z"])
    assert run(start + 61 * MINUTE) == 402 and store.failures(spark).count() == 0
    assert store.unmerged(spark).count() == 0 and convert.convert_range(spark, [str(logs)], store, start + DAY) == 0


def test_a_batch_number_is_given_once(spark, tmp_path):
    store = convert.RequestStore(str(tmp_path / "store"))
    assert [store.batch_of(spark, n) for n in ("a", "b", "a", "c")] == [0, 1, 0, 2]
    assert writers.create_note(spark, store.path("numbers/3"), "another writer")
    assert store.batch_of(spark, "d") == 4 and not writers.create_note(spark, store.path("numbers/4"), "late")


def test_small_tables_are_put_together_and_a_crash_between_changes_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store, now = convert.RequestStore(str(tmp_path / "store")), T0 + 3 * DAY
    for i, name in enumerate(["a", "b", "c"]):                             # one hour merged again and again, and one that is not over
        write_log(logs, name, [f"2026-10-07T06:1{i}:00Z", f"2026-10-10T05:5{i}:00Z"], 200 + i)
        assert convert.convert_files(spark, store, [str(logs / f"{name}.log.gz")], name, now) == 1
        store.roll_days(spark, now)

    def state():
        tables = store.tables(spark)
        return (sorted((r.ts_ms, r.code) for r in tables.requests.select("ts_ms", F.col("elb_code").alias("code")).collect()), sorted(r.ts_ms for r in tables.unmerged.collect()),
                tables.minutes.agg(F.sum("n")).first()[0], sorted(tuple(r) for r in store.rolled(spark).collect()), sorted(r.path for r in store.read(spark, "ledger").collect()))

    def folders(name, mark="batch="):
        return sum(p.is_dir() and p.name.startswith(mark) for p in (tmp_path / "store" / name).rglob("*"))
    assert folders("requests", "upto=") == folders("minutes_by_day", "version=") == 3
    lost = store.batch_of(spark, "lost")                         # taken, its files read, never finished
    store.add(spark.read.text(str(logs / "a.log.gz")).select(F.col("value").alias("raw"), F.lit("lost").alias("file")), lost)
    write_log(logs, "f", ["2026-10-10T05:59:00Z"])
    assert convert.convert_files(spark, store, [str(logs / "f.log.gz")], "f", now) == 1
    before = state()
    assert [len(x) for x in (before[0], before[1], before[3], before[4])] == [4, 5, 0, 5]
    # a compaction that ends before its note
    made, writers.create_note = writers.create_note, lambda *a: False
    try:
        assert not generations.compact(spark, store, now, 1) and state() == before
    finally:
        writers.create_note = made
    assert not generations.compact(spark, store, now, 1000)
    assert generations.compact(spark, store, now, 1) and not generations.compact(spark, store, now, 1) and state() == before
    assert [g.open for g in generations.generations(spark, store)] == [(lost,)]
    generations.collect(spark, store, now)                       # too early: readers may still use the folders
    assert folders("ledger") == 5
    for _ in range(2):
        generations.collect(spark, store, now + HOUR)
    assert state() == before
    assert folders("ledger") == folders("arrived") == 1 and folders("merged") == folders("due") == folders("rolled") == 0
    assert [folders(t, "upto=") for t in ("requests", "minutes", "paths")] == [1, 1, 1] and folders("minutes_by_day", "version=") == folders("paths_by_hour", "version=") == 0
    # a batch that is done isn't done again, whether its name is still known or not; numbers go on
    top = max(int(n) for n in writers.note_names(spark, store.path("numbers")))
    assert convert.convert_files(spark, store, [str(logs / "f.log.gz")], "f", now) == convert.convert_files(spark, store, [str(logs / "a.log.gz")], "a", now) == 0
    assert store.batch_of(spark, "next") > top and store.batch_of(spark, "lost") == lost
    # the lost batch is done after all, and a late file merges the hour again
    assert convert.convert_files(spark, store, [str(logs / "a.log.gz")], "lost", now + 2 * HOUR) == 0
    write_log(logs, "late", ["2026-10-07T06:30:00Z"], 500)
    assert convert.convert_files(spark, store, [str(logs / "late.log.gz")], "late", now + 2 * HOUR) == 1
    store.roll_days(spark, now + 2 * HOUR)
    before = state()
    assert (T0 + 30 * MINUTE, 500) in before[0] and len(before[3]) == 1
    assert generations.compact(spark, store, now + 2 * HOUR, 1) and state() == before and not generations.generations(spark, store)[-1].open[1:]
    generations.collect(spark, store, now + 4 * HOUR)
    assert state() == before and len(generations.generations(spark, store)) == 1 and len(writers.note_names(spark, store.path("base"))) == 1


def test_a_read_after_many_batches_lists_few_files(spark, tmp_path):
    store = convert.RequestStore(str(tmp_path / "store"))
    spark.range(200).selectExpr("concat('f', id) AS path", "id AS batch").repartition(1).write.partitionBy("batch").parquet(store.path("ledger"))
    for batch in range(200):
        assert writers.create_note(spark, store.path(f"numbers/{batch}"), f"n{batch}")
        generations.finish(spark, store, batch)
    assert len(store.read(spark, "ledger").inputFiles()) == 200
    assert generations.compact(spark, store, 0)
    generations.collect(spark, store, HOUR)
    ledger = store.read(spark, "ledger")
    assert len(ledger.inputFiles()) <= 8 and ledger.select("path").distinct().count() == ledger.count() == 200
    assert [len(writers.note_names(spark, store.path(n))) for n in ("ledger", "numbers", "finished")] == [1, 1, 0]   # _SUCCESS, the greatest number
    assert store.batch_of(spark, "more") == 200


def test_hot_hours_are_split_over_tasks(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("'lb' AS lb", "date'2026-01-01' AS dt", "IF(id % 10 = 0, 1, 0) AS hour", "uuid() AS x")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512kb")
    try:
        writers.write_partitions(rows, str(tmp_path / "t"), writers.HOUR_KEYS)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "t").rglob("hour=0/*.parquet"))
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_coverage_and_retention(spark, rows, tmp_path):
    listed = rows([("a", 0, "f1"), ("a", 0, "f2"), ("a", HOUR, "f3"), ("b", 0, "f4")], "lb string, hour_ms bigint, path string")
    ledger = rows([("f1",), ("f4",)], "path string")
    got = sorted(tuple(r) for r in writers.coverage(listed, ledger, 0, 5 * HOUR, HOUR + 30 * MINUTE).collect())
    assert got == [("a", 0, 2, 1, 1), ("b", 0, 1, 1, 0)]
    assert sorted(r.path for r in writers.pending_files(listed, ledger).collect()) == ["f2", "f3"]
    table = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "date_add(date'2026-01-01', int(id)) AS dt").write.partitionBy("dt").parquet(table)
    now = 1_767_225_600_000 + 3 * DAY + HOUR                    # 2026-01-04T01:00Z, two days kept
    assert writers.drop_expired(spark, table, now, 2) == 1
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3, 4]


def test_first_sightings_stream(spark, rows, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "service string, store string, order_id string, ms bigint"
    batches = [[("s", "x", "1", 500), ("s", "x", "2", 900)], [("s", "x", "1", 300), ("s", "x", "3", DAY + 5)], [("s", "x", "2", 950)]]
    for batch in batches:
        rows(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sightings.stream_first_seen(stream, root, str(tmp_path / "checkpoint"), ONCE).awaitTermination()
    want = {("1", 300), ("2", 900), ("3", DAY + 5)}
    assert {(r.order_id, r.first_ms) for r in sightings.read_first_seen(spark, root).collect()} == want
    for _ in range(2):
        sightings.close_days(spark, root, DAY + 4 * HOUR)
    assert {(r.order_id, r.first_ms) for r in sightings.read_first_seen(spark, root).collect()} == want
    assert spark.read.parquet(root + "/final").count() == 2
    late = [("s", "x", "2", 700), ("s", "y", "9", 100)]                # of a day that is final
    sightings.add_batch(rows(late, schema), root, 99)
    for _ in range(2):
        sightings.close_days(spark, root, DAY + 4 * HOUR)
    assert {(r.order_id, r.first_ms) for r in spark.read.parquet(root + "/final").collect()} == {("1", 300), ("2", 700), ("9", 100)}
    assert sightings.read_first_seen(spark, str(tmp_path / "none")).count() == 0
    batches.append(late)
    want = {("1", 300), ("2", 700), ("3", DAY + 5), ("9", 100)}
    everything = rows([r for b in batches for r in b], schema)
    assert {(r.order_id, r.first_ms) for r in orders.first_seen(everything).collect()} == want


def test_changed_lines_count_the_days_anew_and_one_mark_switches(spark, rows, tmp_path):
    paid, shipped = (orders.OrderLine(word, rf"{word} (\d+) for (\w+)", {"order": 1, "store": 2}) for word in ("paid", "shipped"))
    old, new = (sightings.OrderService("web shop/1", "c1", lines) for lines in ([paid], [paid, shipped]))
    assert old.version == sightings.OrderService("web shop/1", "c1", [paid], {}).version != new.version
    said = [(day * DAY + at, f"{word} {order} for {store}") for day, at, word, order, store in [
        (0, 50, "paid", 1, "a"), (0, 40, "shipped", 1, "a"), (1, 70, "paid", 2, "a"), (1, 20, "shipped", 2, "a"), (1, 10, "shipped", 3, "b"),
        (2, 30, "paid", 4, "b"), (2, 31, "paid", 4, "b"), (2, 5, "noise", 4, "b")]]
    logs = rows(said, "log_time_ms bigint, msg string")
    store, days = sightings.CountedOrders(str(tmp_path / "counted")), [date(1970, 1, d) for d in (1, 2, 3)]

    def seen(names=("web shop/1",)):
        return {(r.day.day, r.store, r.order_id, r.first_ms % DAY) for r in store.read(spark, names).collect()}
    assert seen() == set() and store.stale(spark, [old]) == [old]
    store.recount(old, logs, days[0], days[2])
    before = {(1, "a", "1", 50), (2, "a", "2", 70), (3, "b", "4", 30)}
    assert seen() == before and store.stale(spark, [old, new]) == [new]
    # a stream of the new lines starts before its days are counted: nobody sees it yet
    store.add(new, logs.filter("log_time_ms >= 2 * 86400000"), 0)
    assert seen() == before
    for _ in range(2):
        store.recount(new, logs, days[1], days[2])
        assert seen() == {(1, "a", "1", 50), (2, "a", "2", 20), (2, "b", "3", 10), (3, "b", "4", 30)}      # the first day as it was counted
    assert len(store.switches(spark, "web shop/1")) == 2
    store.close(spark, [new], 10 * DAY)
    fresh = sightings.CountedOrders(str(tmp_path / "fresh"))
    fresh.recount(new, logs, days[1], days[2])
    assert {r for r in seen() if r[0] > 1} == {(r.day.day, r.store, r.order_id, r.first_ms % DAY) for r in fresh.read(spark, ["web shop/1"]).collect()}
    store.recount(new, logs, days[0], days[2])                     # further back
    assert (1, "a", "1", 40) in seen() and len(seen()) == 4
    store.recount(old, logs, days[0], days[2])                     # and back to the first lines
    assert seen() == before and store.stale(spark, [new]) == [new]
    assert seen(()) == set() and seen(("other",)) == set()
    store.add(old, rows([], "log_time_ms bigint, msg string"), 7)
    assert seen() == before


def test_ended_days_are_rolled_up_and_late_files_undo_that(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store, now = convert.RequestStore(str(tmp_path / "store")), T0 + 2 * DAY
    query = RequestQuery(T0 - HOUR, T0 + 2 * DAY + 7 * MINUTE)

    def counts(step):
        tables = store.tables(spark)
        found = query.minutes(tables, step), query.paths(tables, step)
        return [sorted((r.t, r.n) for r in f.groupBy(F.expr(f"minute_ms div {HOUR} * {HOUR}").alias("t")).agg(F.sum("n").alias("n")).collect()) for f in found]
    write_log(logs, "a", ["2026-10-07T06:10:00Z", "2026-10-07T06:20:00Z", "2026-10-07T09:20:00Z", "2026-10-08T01:00:00Z", "2026-10-09T06:05:00Z"])
    convert.convert_range(spark, [str(logs)], store, now)
    assert store.tables(spark).long_minutes is None
    for _ in range(2):
        store.roll_days(spark, now)
    long = store.tables(spark).long_minutes
    assert [long.hours.agg(F.sum("n")).first()[0], long.days.count(), long.rest.count()] == [4, 2, 0]     # the third day has not ended
    assert store.read(spark, "rolled").count() == 2
    assert counts(HOUR) == counts(MINUTE)
    write_log(logs, "late", ["2026-10-07T06:30:00Z"])
    convert.convert_range(spark, [str(logs)], store, now)
    long = store.tables(spark).long_minutes
    assert [long.hours.count(), long.rest.agg(F.sum("n")).first()[0]] == [1, 4]                          # back to minutes for that day
    assert counts(HOUR) == counts(MINUTE) and sum(n for _, n in counts(HOUR)[0]) == 6
    store.roll_days(spark, now)
    long = store.tables(spark).long_minutes
    assert [long.days.agg(F.sum("n")).first()[0], long.rest.count()] == [5, 0]
    assert counts(HOUR) == counts(MINUTE)


def test_session_counts_stream(spark, rows, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    data = [(T0 + i * MINUTE, "session", "s.com-session_history-2026.11", "OC", ["M1", None, "probe-1", "77"][i % 4], str(i), f"d{i}",
             "T" if i % 2 else None, "V") for i in range(24)]
    data = data[:14]                                            # within the 15 minutes a window waits
    for part in (data[::2], data[1::2]):                        # the second file brings late entries of the same windows
        rows(part, ENTRY).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTRY).parquet(source)
        session_stream.stream_counts(stream, "probe-", table, str(tmp_path / "checkpoint"), ONCE).awaitTermination()
    assert session_stream.read_counts(spark, str(tmp_path / "none")).count() == 0
    got = {tuple(r) for r in session_stream.read_counts(spark, table).select(*sessions.ROW, "n").collect()}
    want = {tuple(r) for r in sessions.count_entries(rows(data, ENTRY), "probe-").select(*sessions.ROW, "n").collect()}
    assert got == want


def test_runs_make_up_for_missed_ones(spark, rows, tmp_path):
    table, start = str(tmp_path / "counts"), T0 - 2 * HOUR
    data = [(start + i * 100_000, "session" if i % 3 else "cop", "a.com-log", "oc", f"M{i}", None, None, None, None) for i in range(300)]
    late = [(T0 + 8 * MINUTE, "session", "late.com-log", "oc", "M1", None, None, None, None)]
    entries, asked = rows(data, ENTRY), []

    def read(ranges):
        asked.append(ranges)
        return entries
    run = lambda now: session_stream.count_run(spark, read, "probe-", table, now)
    m = MINUTE
    assert run(T0 + 12 * m) == [(T0 - 5 * m, T0 + 10 * m)]       # the first run; the 06:00 block of 4 hours begins at 04:00
    entries = rows(data + late, ENTRY)
    assert run(T0 + 16 * m) == [(T0, T0 + 15 * m)]               # again, with an entry that came late
    writers_write, writers.write_batch = writers.write_batch, lambda *a: 1 / 0
    try:
        run(T0 + 21 * m)
    except ZeroDivisionError:
        pass                                                     # a run that failed before it wrote
    finally:
        writers.write_batch = writers_write
    missed = [(T0 + 15 * m, T0 + 2 * HOUR), (T0 + 2 * HOUR, T0 + 3 * HOUR)]
    for _ in range(2):                                           # repeated after a crash, it counts the same and replaces itself
        assert run(T0 + 3 * HOUR) == missed == asked[-1]
    assert run(T0 + 185 * m) == [(T0 + 170 * m, T0 + 185 * m)]
    got = sorted(tuple(r) for r in session_stream.read_windows(spark, table).select(*sessions.ROW, "n").collect())
    want = sessions.with_coverage(sessions.count_entries(entries, "probe-"), T0 - 5 * m, T0 + 185 * m)
    assert got == sorted(tuple(r) for r in want.select(*sessions.ROW, "n").collect())
    assert run(T0 + 20 * HOUR)[0] == (T0 + 8 * HOUR, T0 + 10 * HOUR)   # no further back than 12 hours
    # an entry that is taken back, as the source is read again
    entries = rows([], ENTRY)
    run(T0 + 20 * HOUR)
    assert session_stream.read_windows(spark, table).filter(F.col("minute_ms") >= T0 + 20 * HOUR - 15 * m).filter("store <> '_all'").count() == 0


def test_alert_stream_gives_the_events_of_the_batch_form(spark, rows, tmp_path):
    found = values(rows, [75, 76, 85, 86, 79, 77, 69, 68], 2).unionByName(values(rows, [90] * 8, 1, "y"))
    repeat = {"warning": 60, "critical": 15}
    source = str(tmp_path / "in")
    for low, high in ((0, 4), (4, 8)):
        found.filter((F.col("at_ms") >= low * 5 * MINUTE) & (F.col("at_ms") < high * 5 * MINUTE)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FINDING).option("maxFilesPerTrigger", 1).parquet(source)
    query = (alerts.alert_stream(stream, None, repeat).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**ONCE).start())
    query.awaitTermination()
    columns = ["subject", "at_ms", "event", "level", "value"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())
    assert got == sorted(tuple(r) for r in state.transitions(found, None, repeat).select(*columns).collect()) and len(got) > 5


def test_inbound_stream_gives_the_rows_of_the_batch_form(spark, rows, tmp_path):
    schema = "snapshot_ms bigint, index string, status string, docs_count bigint, creation_ms bigint"
    runs = [(T0 + i * 5 * MINUTE, {"a.com-order-2026.11": 100 + 7 * i, "b.com-order-2026": 50 - i}) for i in range(4)]
    runs[2][1]["a.com-order-2026.12"] = 40
    data = [(at, index, "open", n, at - MINUTE) for at, counts in runs for index, n in counts.items()]
    snaps = rows(data, schema)
    with_previous = snaps.withColumn("previous_ms", F.when(F.col("snapshot_ms") > T0, F.col("snapshot_ms") - 5 * MINUTE))
    source = str(tmp_path / "in")
    with_previous.coalesce(1).write.parquet(source)
    query = (alerts.inbound_stream(spark.readStream.schema(with_previous.schema).parquet(source)).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**ONCE).start())
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("t", "tenant").agg(F.sum("orders").alias("orders")).filter("orders > 0")
    want = inbound.inbound_delta(snaps).filter("tenant <> '_all'").select("t", "tenant", "orders")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_runs_are_timed_by_the_stream(spark, rows, tmp_path):
    schema = "source string, snapshot_ms bigint, index string, status string, docs_count bigint, creation_ms bigint"
    m, a, b = MINUTE, "a.com-order-2026.11", "b.com-order-2026"
    counted = {0: {a: 100, b: 50}, 5: {a: 107, b: 49}, 10: {a: 107}, 16: {}, 21: {a: 110, b: 60}, 26: {a: 115, b: 60, "c.com-order-2026": 9}}
    data = [(s, T0 + at * m, index, "open", n + k, T0 + at * m if (index or "").startswith("c") else T0 - DAY)
            for k, s in enumerate("xy") for at, run in counted.items() for index, n in (run or {None: 0}).items()]
    pick = lambda f: [r for r in data if f(r[0], (r[1] - T0) // m, r[2])]
    parts = [pick(lambda s, at, i: at == 0 or at == 5 and i == a),
             pick(lambda s, at, i: at == 5 and i == b or at == 16 or s == "y" and at == 10),       # the rest of a run; a run that isn't there yet
             pick(lambda s, at, i: at in (0, 10)),                                                 # ... comes late, with one that is too old
             [], pick(lambda s, at, i: at >= 21), pick(lambda s, at, i: at == 26)]                 # the last one twice
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        rows(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        inbound_stream.stream_inbound(stream, root, str(tmp_path / "checkpoint"), ["source"], ONCE).awaitTermination()
    got = sorted(tuple(r) for r in inbound_stream.read_runs(spark, root, ["source"]).collect())
    want = sorted(tuple(r) for r in inbound.inbound_delta(rows(data, schema), ["source"]).select(*inbound_stream.read_runs(spark, root, ["source"]).columns).collect())
    assert got == want and sum(r[2] == "_all" for r in got) == 10 and len([n for n in os.listdir(root + "/runs") if n.startswith("batch=")]) <= 2
    assert inbound_stream.read_runs(spark, str(tmp_path / "none")) is None


def test_instance_stream_equals_the_batch_rows_over_shuffled_batches(spark, rows, tmp_path):
    history, services = checks_of_instances(rows)
    end = rows([(BASE + 90 * HOUR, c, "z", "ACTIVE", True) for c in "cd"], "at_ms bigint, cluster string, instance_id string, status string, agent_connected boolean")
    parts = [[6, 1, 9], [0, 2, 3, 11], [4, 5, 7, 8, 10], [30, 12, 25], [*range(13, 25), *range(26, 30), *range(31, 40)]]
    for name, df in (("history", history), ("services", services)):
        for part in parts:
            df.filter(((F.col("at_ms") - BASE) / HOUR).isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "history"))
    streams = []
    for name, df in (("history", history), ("services", services)):
        files = sorted((tmp_path / name).glob("*.parquet"), key=os.path.getmtime)
        for i, f in enumerate(files):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))         # files are taken in this order
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    query = (alerts.instance_stream(*streams, delay="40 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**ONCE).start())
    query.awaitTermination()
    got = sorted((f"{r.cluster} / {r.instance_id}", r.at_ms, r.bad) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.subject, r.at_ms, r.bad) for r in rules.ecs_instances(history, services, "r").collect())
    assert set(want) - set(got) == set() and got == want
    assert len(got) > 80 and len(query.recentProgress) > 4
