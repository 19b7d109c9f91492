import json

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from opslens.operators import errors, search
from opslens.operators.search import Filter, LogQuery, QueryError
from opslens.sources import readers, writers

SCHEMA = "id int, log_time_ms bigint, msg string, level string, code bigint, ratio double, ok boolean, raw string"
DATA = [(1, 10, "Timeout at 50% load", "ERROR", 500, 0.5, True, None), (2, 20, "ok user_1 done", "INFO", 200, 1.5, False, None),
        (3, 30, None, None, None, None, None, None), (4, 40, "plain", "error", 404, 2.5, True, "C:\\temp TIMEOUT"),
        (5, 50, "userX1 done", "WARN", 200, None, None, None)]


@pytest.fixture
def logs(rows):
    return rows(DATA, SCHEMA)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("text, want", [
    ("timeout", [1, 4]), ("-timeout", [2, 3, 5]), ("50%", [1]), ("user_1", [2]), ("c:\\temp", [4]), ('"at 50%"', [1]),
    ('-"at 50%" timeout', [4]), ("level:error", [1, 4]), ("-level:error", [2, 3, 5]), ("level:*r*", [1, 4, 5]), ("code:404", [4]),
    ("-code:200", [1, 3, 4]), ("ok:true", [1, 4]), ("nosuch:x", []), ("", [1, 2, 3, 4, 5]), ("-", []), ('""', [1, 2, 3, 4, 5]),
    ('level:"error"', [1, 4]), ("ok", [2])])
def test_words(logs, text, want):
    assert ids(LogQuery(text=text).apply(logs)) == want


@pytest.mark.parametrize("f, want", [
    (Filter("level", "is", "ERROR"), [1]), (Filter("level", "is_not", "ERROR"), [2, 3, 4, 5]),
    (Filter("code", "one_of", values=[200, "404"]), [2, 4, 5]), (Filter("code", "not_one_of", values=[200]), [1, 3, 4]),
    (Filter("code", "contains", "0"), [1, 2, 4, 5]), (Filter("msg", "not_contains", "DONE"), [1, 3, 4]),
    (Filter("msg", "exists"), [1, 2, 4, 5]), (Filter("msg", "not_exists"), [3]), (Filter("code", "gte", 404), [1, 4]),
    (Filter("ratio", "lte", "1.5"), [1, 2]), (Filter("code", "between", gte=201), [1, 4]),
    (Filter("code", "between", gte=201, lte=404), [4]), (Filter("ok", "is", "False"), [2])])
def test_filters(logs, f, want):
    assert ids(LogQuery(filters=[f]).apply(logs)) == want


@pytest.mark.parametrize("f", [Filter("nope", "is", 1), Filter("code", "is", "x"), Filter("ok", "is", "yes"), Filter("code", "near", 1),
                               Filter("code", "is"), Filter("code", "one_of", values=[]), Filter("code", "between"),
                               Filter("msg", "contains", "")])
def test_bad_filters(logs, f):
    with pytest.raises(QueryError):
        LogQuery(filters=[f]).apply(logs)


def test_time_range_is_inclusive(logs):
    assert ids(LogQuery(20, 40).apply(logs)) == [2, 3, 4]


def test_time_is_skipped_without_the_column(logs):
    assert ids(LogQuery(20, 40).apply(logs.drop("log_time_ms"))) == [1, 2, 3, 4, 5]


def test_no_text_columns(logs):
    with pytest.raises(QueryError):
        LogQuery(text="x").apply(logs.select("id", "code"))


def test_histogram_and_facets(logs):
    assert sorted(tuples(search.histogram(logs, 20))) == [(0, "ERROR", 1), (20, "INFO", 1), (20, "OTHER", 1), (40, "ERROR", 1), (40, "WARN", 1)]
    top = tuples(search.facets(logs, ["level", "host"], 2))
    assert sorted(top) == [("level", "ERROR", 1, 1), ("level", "INFO", 1, 2)]
    buckets = {r["t"]: (r["count"], r["levels"]) for r in search.histogram_buckets(logs, 20).collect()}
    assert buckets[40] == (2, {"ERROR": 1, "WARN": 1})


def test_facet_rank_is_cut_before_the_shuffle(logs):
    plan = search.facets(logs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_log_files_end_to_end(spark, tmp_path):
    """Hour folders, columns joined by name, references, pages, one record."""
    root = str(tmp_path)
    for hour, columns in ((5, "id AS log_time_ms, 'a' AS msg"), (6, "id + 100 AS log_time_ms, 'b' AS msg, 'x' AS extra"), (7, "id AS log_time_ms")):
        spark.range(3).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(f"{root}/c1/dt=2026-11-09/hour={hour:02d}")
    unread = tmp_path / "c1" / "dt=2026-11-09" / "hour=08"
    unread.mkdir()
    (unread / "part-broken.parquet").write_text("reading this file would fail")
    day = int(spark.sql("SELECT unix_millis(timestamp'2026-11-09 00:00:00')").first()[0])
    logs = readers.read_logs(spark, root, "c1", day + 5 * 3600_000, day + 6 * 3600_000 + 1)
    assert set(logs.columns) >= {"log_time_ms", "msg", "extra", "dt", "hour"} and logs.count() == 6
    refs = search.with_row_ref(logs)
    newest = search.page(refs, 2, 1).select("log_time_ms", "_file", "_row").collect()
    assert [r.log_time_ms for r in newest] == [101, 100]
    last = newest[-1]
    after = search.page_after(refs, 2, (last.log_time_ms, last._file, last._row)).select("log_time_ms").collect()
    assert [r[0] for r in after] == [2, 1]
    folder = newest[0]._file.rsplit("/dt=", 1)[0]
    record = search.record(logs, folder, newest[0]._file, newest[0]._row).collect()
    assert len(record) == 1 and record[0].log_time_ms == 101 and record[0].extra == "x"
    with pytest.raises(QueryError):
        search.record(logs, folder, folder + "/../other/x.parquet", 0)


def test_cluster_names(spark, rows):
    names = rows([("b",), ("a.1",), ("-x",), ("b",), ("bad name",)], "cluster string")
    assert [r[0] for r in readers.list_clusters(names).collect()] == ["a.1", "b"]


def test_truncated_cells(rows):
    df = search.truncate_cells(rows([("x" * 1600, 1), ("y", 2), (None, 3)], "msg string, n int"))
    assert [(len(r.msg or ""), r._truncated) for r in df.orderBy("n").collect()] == [(1500, True), (1, False), (0, False)]


def test_ordered_columns():
    assert search.ordered_columns(["zz", "msg", "log_time", "aa"]) == ["log_time", "msg", "zz", "aa"]


def test_exports(spark, rows, tmp_path):
    data = rows([(1, "a,\"b\"", None), (2, None, 5)], "log_time_ms bigint, msg string, n int")
    picked = search.export_rows(data, ["msg", "n"], 10, keys=("log_time_ms",))
    assert tuples(picked) == [(None, 5), ('a,"b"', None)]
    for fmt in ("csv", "ndjson", "json"):
        writers.export(picked, str(tmp_path / fmt), fmt)

    def text(fmt):
        return next((tmp_path / fmt).glob("part-*")).read_text()
    assert text("csv") == 'msg,n\n"",5\n"a,""b""",""\n' or text("csv").splitlines()[0] == "msg,n"
    assert text("ndjson") == '{"n":5}\n{"msg":"a,\\"b\\""}\n'
    assert [x for f in (tmp_path / "json").glob("part-*") for x in json.loads(f.read_text())] == [{"n": 5}, {"msg": 'a,"b"'}]
    report = writers.export_report(data, data.limit(1)).first()
    assert (report.rows, report.total) == (1, 2)


# ---- kinds of error
def test_error_kinds(rows):
    data = [(10 + i, "ERROR", "x.BoomException", f"Order {i} failed for a-{i}.myshopify.com tenantId: t{i % 2}ab", "svc", "com.A", "run", i % 2)
            for i in range(6)] + [(50, "ERROR", None, "  \n", None, None, None, None)]
    logs = rows(data, "log_time_ms bigint, level string, exception string, msg string, service string, class string, method string, line int")
    groups = {(r.exception, r.key): r for r in errors.error_groups(logs).collect()}
    boom = groups[("x.BoomException", "Order <*> failed for <store> tenantId: <*>")]
    assert boom.n == 6 and boom.stores == [f"a-{i}" for i in range(6)] and boom.tenants == ["t0ab", "t1ab"]
    assert boom.location == "A.run:0" and boom.service == "svc" and boom.error == boom.key
    assert (boom.kinds, boom.total) == (2, 7) and groups[("", "")].n == 1


def test_all_variants_make_the_template(rows):
    """The forty-first variant alone differs in a word."""
    lines = [f"one two three four five six seven eight same tail{chr(97 + i % 26)}{'x' * i}" for i in range(40)]
    kind = errors.error_kinds(rows([(x,) for x in [*lines, "one two three four five six seven eight zzz tail"]], "msg string")).first()
    assert kind.n == kind.n_variants == 41 and kind.error == "one two three four five six seven eight <*>"


def test_the_screen_shows_forty_variants(rows):
    logs = rows([(f"one two three four five six seven eight tail{chr(97 + i % 26)}{'x' * i}",) for i in range(60)], "msg string")
    kind = errors.error_kinds(logs, errors.Cut(variants=40)).first()
    assert kind.n == 60 and len(kind.variants) == 40 and kind.error == "one two three four five six seven eight <*>"


def read_times(spark, grouped, n: int = 40) -> int:
    """How often ``grouped`` of ``n`` lines reads each of them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(i):
        seen.add(1)
        return f"kind {'abcd'[i % 4]} of a line: {'x' * i} {i} done"
    assert len(grouped(spark.range(0, n, 1, 1).select(said("id").alias("msg"))).collect()) == n
    assert seen.value % n == 0
    return seen.value // n


def test_lines_are_read_for_sums_totals_and_variants_only(spark):
    assert read_times(spark, lambda logs: errors.error_groups(logs, None)) <= 3


def test_shown_kinds_share_the_reading_of_variants(spark):
    assert read_times(spark, lambda logs: errors.error_groups(logs, 40, errors.Cut(True, 1000, 600, 40))) <= 4


def test_a_limited_list_reads_each_line_once(spark):
    assert read_times(spark, lambda logs: errors.error_groups(logs, 40, errors.Cut(True, 1000, 600, 40))) == 1


def test_a_limited_list_tells_the_same_of_its_kinds(rows):
    """Variants, places, stores and tenants of a kind are spread over its tallies; one kind has none of them."""
    data = [(f"x.E{i % 2}", f"one two three four five six seven eight tail{'abc'[i % 3]} of s{i % 5}.myshopify.com tenant=t-{i % 4}", f"svc-{i % 3}",
             [None, "a.B", "a.A", "a.A", "a.B", None, None][i % 7], None) for i in range(140)]
    logs = rows([*data, (None, "plain", None, None, None), (None, " plain ", "z", None, "t9"), ("x.E0", None, None, "a.C", None)],
                "exception string, msg string, service string, class string, tenant_id string")
    few, every = (errors.error_groups(logs, n, errors.Cut(variants=2)) for n in (100, None))
    assert few.columns == every.columns
    found = tuples(few)
    assert found == tuples(every) and len(found) == 4
    first = few.first()
    assert (first.n, first.n_variants, first.location, first.stores, first.tenants) == (70, 3, "A", [f"s{i}" for i in range(5)], ["t-0", "t-2"])
    cut = errors.error_groups(logs, 1, errors.Cut(variants=2)).collect()
    assert cut == [first] and (first.kinds, first.total) == (4, 143)


def test_an_empty_limited_list(rows):
    assert errors.error_groups(rows([], "msg string")).collect() == []


def test_words_of_a_kind_do_not_meet_by_position(rows):
    """Positions come from the smallest line and from those that differ, not from every word of every line."""
    lines = [f"one two three four five six seven eight {'same ' * 300}tail{'x' * i}" for i in range(40)]
    found = errors.templates(rows([("", "k", x) for x in lines], "exception string, key string, normalized string"))
    assert found.collect()[0].error == "one two three four five six seven eight " + "same " * 300 + "<*>"
    nodes, made = [found._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            made += node.metrics().apply("numOutputRows").value()
    assert 0 < made <= 309 + 39


def test_muted_kinds_are_left_out(rows):
    groups = rows([("no such index [a]", "no such index [<*>]"), ("Invalid zip D01", "Invalid zip <*>")], "example string, error string")
    assert [r.example for r in errors.without_muted(groups, ["NO SUCH"]).collect()] == ["Invalid zip D01"]


def test_ranges_without_folders_have_no_lines(spark, tmp_path):
    folder = tmp_path / "shop-1" / "dt=2026-01-01" / "hour=05"
    spark.createDataFrame([(5 * 3_600_000,)], "log_time_ms bigint").write.parquet(str(folder))
    assert readers.list_cluster_folders(spark, str(tmp_path)) == ["shop-1"]
    assert readers.read_logs(spark, str(tmp_path), "shop-1", 0, 3_600_000).count() == 0
    assert readers.read_logs(spark, str(tmp_path), "shop-2", 0, 3_600_000).count() == 0
    assert readers.read_api_metrics(spark, [str(tmp_path / "none" / "dt=*")]).count() == 0


def test_types_are_widened():
    from pyspark.sql import types as T

    from opslens.sources.schemas import widened
    kinds = {"tinyint": T.ByteType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "text": T.StringType(),
             "yes": T.BooleanType(), "money": T.DecimalType(10, 2), "more": T.DecimalType(12, 4), "day": T.DateType(), "time": T.TimestampType(), "none": T.NullType()}
    for a, b, want in [("int", "bigint", "bigint"), ("tinyint", "int", "int"), ("bigint", "double", "double"), ("float", "double", "double"), ("bigint", "text", "text"),
                       ("yes", "int", "text"), ("yes", "text", "text"), ("money", "int", "double"), ("day", "time", "time"), ("none", "day", "day"), ("day", "text", "text")]:
        assert widened(kinds[a], kinds[b]) == widened(kinds[b], kinds[a]) == kinds[want]
    assert widened(kinds["money"], kinds["more"]) == T.DecimalType(12, 4)


def test_files_of_several_types_are_read_as_one(spark, tmp_path, monkeypatch):
    from opslens.sources import schemas
    start = 1_767_225_600_000
    values = [F.lit(1).alias("v"), F.lit(2**40).alias("v"), F.lit(0.5).alias("v"), F.lit("x").alias("v"), F.lit(7).alias("other")]
    for hour, v in enumerate(values):
        spark.range(1).select(F.lit(start + hour * 3_600_000).alias("log_time_ms"), v).coalesce(1).write.parquet(str(tmp_path / f"a/dt=2026-01-01/hour={hour:02d}"))
    for few in (64, 1):
        monkeypatch.setattr(schemas, "FEW", few)
        for upto, want in ((1, ["1", str(2**40)]), (2, ["1.0", str(float(2**40)), "0.5"]), (4, ["1", str(2**40), "0.5", "x", "None"])):
            logs = readers.read_logs(spark, str(tmp_path), "a", start, start + upto * 3_600_000).orderBy("log_time_ms")
            assert [str(r.v) for r in logs.collect()] == want
    found = search.with_row_ref(logs)
    last = found.filter("v = 'x'").first()
    assert search.record(found, last["_file"].rsplit("/dt=", 1)[0], last["_file"], last["_row"]).first().v == "x"
