"""Log search and error grouping over the log stand-ins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.times import DAY, HOUR, zone_text
from ..operators import errors, search
from ..operators.search import Filter, LogQuery
from . import views
from .oracle import sql
from .registry import Registry

QUERIES = Registry()

START, END = 1704067200000 + 2 * DAY, 1704067200000 + 20 * DAY + 12345        # 2024-01-03 … 2024-01-21
KEEP = ["row_id", "log_time_ms", "level", "service", "msg"]


def _search(name: str, query: LogQuery, where: str, source=views.logs, table: str = "v_logs", keep=tuple(KEEP)) -> None:
    timed = f"log_time_ms BETWEEN {query.start_ms} AND {query.end_ms} AND " if query.start_ms is not None else ""

    @QUERIES.add(name, sql(f"SELECT {', '.join(keep)} FROM {table} WHERE {timed}{where}"))
    def run(spark, sf_dir):
        return query.apply(source(spark, sf_dir)).select(*keep)


def _any(*needles: str, columns=("msg", "exception")) -> str:
    return "(" + " OR ".join(f"coalesce(lower({c}) LIKE '%' || lower('{n}') || '%', false)"
                             for n in needles for c in columns) + ")"


def _timed(text: str = "", *filters: Filter) -> LogQuery:
    return LogQuery(START, END, text, filters)


# F1-F5: free text
_search("log_search_text", _timed("user PURCHASE"), f"{_any('user')} AND {_any('purchase')}")
_search("log_search_phrase", _timed('"user 12"'), _any("user 12"))
_search("log_search_negation", _timed('-error -"user 1"'), f"NOT {_any('error')} AND NOT {_any('user 1')}")
_search("log_search_field", _timed("level:error -service:svc-2"),
        "coalesce(lower(level) = 'error', false) AND NOT coalesce(lower(service) = 'svc-2', false)")
_search("log_search_wildcard", _timed("exception:*.E1 host:HOST-*"),
        "coalesce(lower(exception) LIKE '%.e1', false) AND coalesce(lower(host) LIKE 'host-%', false)")
_search("log_search_typed_field", _timed("response_time_ms:12 parse_ok:true"),
        "coalesce(response_time_ms = 12, false) AND coalesce(parse_ok = true, false)")
_search("log_search_unknown_field", _timed('-nosuch:field -"%" -"click user 1_"'),
        f"NOT {_any('nosuch:field')} AND NOT contains(msg, '%')")
_search("log_search_documents", LogQuery(text='the -"and" level:en'),
        "lower(msg) LIKE '%the%' AND NOT lower(msg) LIKE '%and%' AND lower(level) = 'en'", views.texts, "v_text",
        ("row_id", "service", "level"))

# F6-F11: filters
for _name, _filter, _where in [
    ("is", Filter("level", "is", "ERROR"), "coalesce(level = 'ERROR', false)"),
    ("is_not", Filter("level", "is_not", "ERROR"), "NOT coalesce(level = 'ERROR', false)"),
    ("one_of", Filter("level", "one_of", values=["INFO", "WARN"]), "coalesce(level IN ('INFO', 'WARN'), false)"),
    ("not_one_of", Filter("level", "not_one_of", values=["INFO", "WARN"]),
     "NOT coalesce(level IN ('INFO', 'WARN'), false)"),
    ("contains", Filter("exception", "contains", "lang.e2"), "coalesce(lower(exception) LIKE '%lang.e2%', false)"),
    ("not_contains", Filter("exception", "not_contains", "lang.e2"),
     "NOT coalesce(lower(exception) LIKE '%lang.e2%', false)"),
    ("exists", Filter("exception", "exists"), "exception IS NOT NULL"),
    ("not_exists", Filter("exception", "not_exists"), "exception IS NULL"),
    ("gte", Filter("response_time_ms", "gte", "40"), "response_time_ms >= 40"),
    ("lte", Filter("response_time_ms", "lte", 40), "response_time_ms <= 40"),
    ("between", Filter("response_time_ms", "between", gte=20, lte=40), "response_time_ms BETWEEN 20 AND 40"),
    ("boolean", Filter("parse_ok", "is", "false"), "coalesce(parse_ok = false, false)"),
]:
    _search(f"log_filter_{_name}", _timed("", _filter), _where)


@QUERIES.add("log_count", sql(f"""SELECT count(*) AS total FROM v_logs WHERE log_time_ms BETWEEN {START} AND {END}
    AND coalesce(lower(level) = 'error', false)"""))
def log_count(spark, sf_dir):
    return search.count_matches(_timed("level:error").apply(views.logs(spark, sf_dir)))


@QUERIES.add("log_histogram", sql(f"""SELECT log_time_ms // {12 * HOUR} * {12 * HOUR} AS t,
    coalesce(upper(level), 'OTHER') AS level, count(*) AS n FROM v_logs
    WHERE log_time_ms BETWEEN {START} AND {END} AND NOT {_any('purchase')} GROUP BY ALL"""))
def log_histogram(spark, sf_dir):
    from ..functions.times import histogram_step
    matches = _timed("-purchase").apply(views.logs(spark, sf_dir))
    return search.histogram(matches, histogram_step(END - START))


@QUERIES.add("log_facets", sql(f"""WITH m AS (SELECT * FROM v_logs WHERE log_time_ms BETWEEN {START} AND {END}),
    u AS (UNPIVOT (SELECT level, service, host, exception FROM m) ON level, service, host, exception
          INTO NAME field VALUE value)
    SELECT field, value, n, CAST(rank AS INTEGER) AS rank FROM (
      SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank
      FROM u GROUP BY field, value) WHERE rank <= 8"""))
def log_facets(spark, sf_dir):
    return search.facets(_timed().apply(views.logs(spark, sf_dir)))


@QUERIES.add("log_page", sql(f"""SELECT row_id, log_time_ms, msg FROM v_logs
    WHERE log_time_ms BETWEEN {START} AND {END} AND coalesce(level = 'ERROR', false)
    ORDER BY log_time_ms DESC, row_id DESC LIMIT 50 OFFSET 100"""))
def log_page(spark, sf_dir):
    """Paged by (time, row) of the scanned file: the row index is the file's own."""
    logs = search.with_row_ref(views.table(spark, sf_dir, "events")).select("event_id", "_row")
    refs = logs.join(views.logs(spark, sf_dir).withColumnRenamed("row_id", "event_id"), "event_id")
    matches = _timed("", Filter("level", "is", "ERROR")).apply(refs)
    return search.page(matches, 50, 100, keys=("log_time_ms", "_row")).select(F.col("event_id").alias("row_id"),
                                                                               "log_time_ms", "msg")


@QUERIES.add("log_page_after", sql(f"""SELECT row_id, log_time_ms FROM v_logs
    WHERE (log_time_ms, row_id) > ({START}, 700) ORDER BY log_time_ms, row_id LIMIT 100"""))
def log_page_after(spark, sf_dir):
    return search.page_after(views.logs(spark, sf_dir).select("row_id", "log_time_ms"), 100, (START, 700),
                             descending=False, keys=("log_time_ms", "row_id"))


@QUERIES.add("log_record", sql("SELECT event_id, event_type, props FROM events WHERE event_id = 4321 % (SELECT count(*) "
                               "FROM events)"))
def log_record(spark, sf_dir):
    events = search.with_row_ref(views.table(spark, sf_dir, "events"))
    total = views.table(spark, sf_dir, "events").agg(F.lit(4321) % F.count("*")).scalar()
    return events.filter(F.col("_row") == total).select("event_id", "event_type", "props")


@QUERIES.add("log_truncated", sql("""SELECT row_id, left(msg, 1500) AS msg, service, level,
    length(msg) > 1500 AS _truncated FROM v_text"""))
def log_truncated(spark, sf_dir):
    return search.truncate_cells(views.texts(spark, sf_dir)).select("row_id", "msg", "service", "level", "_truncated")


@QUERIES.add("log_export_zone", sql(f"""SELECT row_id, strftime(make_timestamp(log_time_ms * 1000) + INTERVAL 330 MINUTE,
    '%Y-%m-%d %H:%M:%S.%g') || ' +05:30' AS log_time, level FROM v_logs
    WHERE log_time_ms BETWEEN {START} AND {END} ORDER BY log_time_ms DESC, row_id DESC"""))
def log_export_zone(spark, sf_dir):
    logs = _timed().apply(views.logs(spark, sf_dir)).withColumn("log_time", F.lit(None).cast("string"))
    return search.export_rows(logs, ["row_id", "log_time", "level"], zone="Asia/Kolkata",
                              keys=("log_time_ms", "row_id"))


@QUERIES.add("log_clusters", sql("SELECT DISTINCT cluster FROM v_logs"))
def log_clusters(spark, sf_dir):
    from ..sources.readers import list_clusters
    return list_clusters(views.logs(spark, sf_dir))


# P15-P19, A4, A5: kinds of error
# What varies between lines of one kind, as in the functions package.
_NORMAL = "line"
for _rx, _to in [
    (r"[A-Za-z0-9-]+\.myshopify\.com", "<store>"),
    (r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?(\.\d+)?Z?", "<time>"),
    (r"""(^|[\s/\[("''])([1-5][0-9][0-9])( [A-Z][a-z])""", r"\1§\2§\3"),
    (r"""(^|[\s,;:=()\[\]{}"''|/])([^\s,;:=()\[\]{}"''|/§]*[0-9][^\s,;:=()\[\]{}"''|/]*)""", r"\1<*>"),
    (r"<\*>(?:[\s,|]*<\*>)+", "<*>"),
    (r"§([1-5][0-9][0-9])§", r"\1"),
]:
    _NORMAL = f"regexp_replace({_NORMAL}, '{_rx}', '{_to}', 'g')"
_LINE = "trim(regexp_replace(coalesce(nullif(trim(msg), ''), ''), '\\s+', ' ', 'g'))"
_SHOWN = "trim(regexp_replace(left(split_part(coalesce(nullif(trim(msg), ''), ''), chr(10), 1), 1000), '\\s+', ' ', 'g'))"
#: what the original shows of a kind
SCREEN = errors.Cut(first_line=True, line_chars=1000, normalized_chars=600, variants=40)


def kinds_sql(source: str, exception: str, line: str = _LINE, normal: str = _NORMAL, also: str = "") -> str:
    return f"""
      t AS (SELECT {exception} AS exception, {line} AS line, service{also} FROM {source}),
      d AS (SELECT *, {normal} AS normalized FROM t),
      k AS (SELECT *, array_to_string(string_split(normalized, ' ')[1:8], ' ') AS key FROM d),
      g AS (SELECT exception, key, count(*) AS n, min(line) AS example, min(service) AS service, count(DISTINCT normalized) AS n_variants,
                   array_to_string(list_sort(list(DISTINCT normalized))[1:40], '~') AS variants
            FROM k GROUP BY exception, key)"""


#: the template of a kind from its list of variants, by word positions
TEMPLATES_SQL = r"""
      v AS (SELECT exception, key, list_sort(list(DISTINCT normalized)) AS lines FROM k GROUP BY ALL),
      w AS (SELECT *, list_transform(lines, lambda x: string_split(x, ' ')) AS words FROM v),
      s AS (SELECT *, list_min(list_transform(words, lambda x: len(x))) AS shortest, list_max(list_transform(words, lambda x: len(x))) AS longest FROM w),
      a AS (SELECT *, list_transform(range(1, shortest + 1), lambda i: len(list_distinct(list_transform(words, lambda x: x[i]))) = 1) AS ahead,
                   list_transform(range(1, shortest + 1), lambda i: len(list_distinct(list_transform(words, lambda x: x[len(x) + 1 - i]))) = 1) AS behind FROM s),
      p AS (SELECT *, coalesce(nullif(list_position(ahead, false), 0), shortest + 1) - 1 AS head,
                   coalesce(nullif(list_position(behind, false), 0), shortest + 1) - 1 AS rear FROM a),
      e AS (SELECT exception, key, CASE WHEN len(lines) = 1 THEN lines[1]
              WHEN shortest = longest THEN regexp_replace(array_to_string(list_transform(range(1, shortest + 1),
                lambda i: CASE WHEN ahead[i] THEN words[1][i] ELSE '<*>' END), ' '), '<\*>(?:[\s,|]*<\*>)+', '<*>', 'g')
              ELSE trim(array_to_string(words[1][1:head], ' ') || ' …' || CASE WHEN least(rear, shortest - head) > 0
                THEN ' ' || array_to_string(words[1][len(words[1]) + 1 - least(rear, shortest - head):], ' ') ELSE '' END) END AS error FROM p)"""
EXCEPTION_SQL = "coalesce(exception, '')"
_SUMS = "(SELECT count(*) FROM g) AS kinds, CAST((SELECT sum(n) FROM g) AS BIGINT) AS total FROM g"


@QUERIES.add("error_kinds", sql(f"""WITH {kinds_sql('v_logs', EXCEPTION_SQL, _SHOWN, f'left({_NORMAL}, 600)')}
    SELECT exception, key, n, example, service, variants, {_SUMS} ORDER BY n DESC, key, exception LIMIT 200"""))
def error_kinds(spark, sf_dir):
    groups = errors.error_groups(views.logs(spark, sf_dir), 200, SCREEN)
    return groups.select("exception", "key", "n", "example", "service", F.array_join("variants", "~").alias("variants"), "kinds", "total")


@QUERIES.add("error_kinds_documents", sql(f"WITH {kinds_sql('v_text', chr(39) * 2)} SELECT exception, key, n, example, service, n_variants, {_SUMS}"))
def error_kinds_documents(spark, sf_dir):
    groups = errors.error_groups(views.texts(spark, sf_dir), None)
    return groups.select("exception", "key", "n", "example", "service", "n_variants", "kinds", "total")


@QUERIES.add("error_lines", sql(f"WITH {kinds_sql('v_text', chr(39) * 2)} SELECT line AS text, normalized, key, service FROM k"))
def error_lines(spark, sf_dir):
    return errors.error_lines(views.texts(spark, sf_dir)).select("text", "normalized", "key", "service")


@QUERIES.add("error_templates", sql(f"WITH {kinds_sql('v_logs', EXCEPTION_SQL)}, {TEMPLATES_SQL} SELECT exception, key, n, n_variants, error FROM g JOIN e USING (exception, key)"))
def error_templates(spark, sf_dir):
    return errors.error_kinds(views.logs(spark, sf_dir)).select("exception", "key", "n", "n_variants", "error")


#: log lines that name stores, tenants and the place in the code
_PLACED = ["event_type || ' of a' || user_id % 9 || '.myshopify.com failed, tenant_id=t-' || user_id % 4 || ' in step ' || event_id AS msg",
           "'svc-' || user_id % 5 AS service", "CASE WHEN event_type = 'error' THEN 'java.lang.E' || user_id % 3 END AS exception",
           "'com.shop.Worker$K' || user_id % 2 AS class", "'run' AS method", "event_id % 3 AS line", "CASE WHEN event_id % 10 = 0 THEN ' t-0 ' END AS tenant_id"]


@QUERIES.add("error_kinds_full", sql(f"""WITH placed AS (SELECT {', '.join(x.replace(' AS line', ' AS code_line') for x in _PLACED)} FROM events),
    {kinds_sql('placed', EXCEPTION_SQL, also=", 'K' || right(class, 1) || '.run:' || code_line AS location, split_part(split_part(msg, ' of ', 2), '.', 1) AS store, coalesce(trim(tenant_id), 't-' || split_part(msg, 'tenant_id=t-', 2)[1]) AS tenant")},
    l AS (SELECT exception, key, first(location ORDER BY m DESC, location) AS location FROM (SELECT exception, key, location, count(*) AS m FROM k GROUP BY ALL) GROUP BY ALL),
    o AS (SELECT exception, key, string_agg(DISTINCT store, ',' ORDER BY store) AS stores, string_agg(DISTINCT tenant, ',' ORDER BY tenant) AS tenants FROM k GROUP BY ALL), {TEMPLATES_SQL}
    SELECT exception, key, n, example, service, n_variants, stores, tenants, location, error FROM g JOIN l USING (exception, key) JOIN o USING (exception, key) JOIN e USING (exception, key)"""))
def error_kinds_full(spark, sf_dir):
    kinds = errors.error_kinds(views.table(spark, sf_dir, "events").selectExpr(*_PLACED))
    return kinds.select("exception", "key", "n", "example", "service", "n_variants", F.array_join("stores", ",").alias("stores"),
                        F.array_join("tenants", ",").alias("tenants"), "location", "error")


@QUERIES.add("error_labels", sql("""SELECT row_id, 'E' || split_part(exception, '.E', 2) || ': ' || msg AS label
    FROM v_logs WHERE exception IS NOT NULL"""))
def error_labels(spark, sf_dir):
    logs = views.logs(spark, sf_dir).filter(F.col("exception").isNotNull())
    return logs.select("row_id", X.error_label(F.col("exception"), F.col("msg")).alias("label"))


@QUERIES.add("error_texts", sql("""SELECT row_id, t AS text
    FROM (SELECT row_id, trim(regexp_replace(msg, '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t
          FROM v_text)"""))
def error_texts(spark, sf_dir):
    none = F.lit(None).cast("string")
    return views.texts(spark, sf_dir).select("row_id", X.error_text(F.col("msg"), none, none, none).alias("text"))


@QUERIES.add("log_time_zone", sql("""SELECT row_id, strftime(make_timestamp(log_time_ms * 1000) - INTERVAL 480 MINUTE,
    '%Y-%m-%d %H:%M:%S.%g') || ' -08:00' AS local FROM v_logs"""))
def log_time_zone(spark, sf_dir):
    return views.logs(spark, sf_dir).select("row_id", zone_text(F.col("log_time_ms"), "America/Los_Angeles")
                                            .alias("local"))
