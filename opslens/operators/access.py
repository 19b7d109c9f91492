"""Raw load balancer access lines -> request rows -> minute and path roll-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P
from ..functions import web
from ..functions.times import MINUTE, floor_to, parse_iso_ms


def _dash(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("-"))


def _seconds(c: str) -> Column:
    """-1 ("no answer") and junk are NULL."""
    value = F.col(c).try_cast("double")
    return F.when(value >= 0, value)


def tokenize(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """The line as it is, and the documented fields by position without their quotes."""
    token = F.col("_tokens")

    def field(i: int) -> Column:
        t = F.get(token, F.lit(i))
        quoted = F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')) & (t != '"')
        return F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return (lines.filter(F.col(raw).isNotNull() & (F.col(raw) != ""))
            .select(F.col(raw).alias("raw"), F.regexp_extract_all(raw, F.lit(P.ACCESS_TOKEN), 0).alias("_tokens"))
            .select("raw", *[field(i).alias(name) for i, name in enumerate(P.ACCESS_FIELDS)]))


def parse_requests(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Request rows of raw access lines."""
    request = F.col("request")

    def word(n: int) -> Column:
        return F.nullif(F.split_part(request, F.lit(" "), F.lit(n)), F.lit("-"))
    fields = tokenize(lines, raw)
    parsed = fields.select(
        _dash("time").alias("time"), parse_iso_ms(F.col("time")).alias("ts_ms"),
        F.split_part("elb", F.lit("/"), F.lit(2)).alias("lb"),
        web.empty_to_null(F.regexp_extract("target_group_arn", r"targetgroup/([^/]+)/", 1)).alias("tg"),
        _dash("domain_name").alias("domain"), word(1).alias("method"),
        web.empty_to_null(word(2)).alias("url"), web.empty_to_null(word(3)).alias("protocol"),
        F.col("elb_status_code").try_cast("smallint").alias("elb_code"),
        F.col("target_status_code").try_cast("smallint").alias("tgt_code"),
        web.empty_to_null(F.regexp_extract("client", r"^(.*):[0-9]+$", 1)).alias("client_ip"),
        F.regexp_extract("client", r":([0-9]+)$", 1).try_cast("int").alias("client_port"),
        _dash("target").alias("target"), _seconds("request_processing_time").alias("req_t"),
        _seconds("target_processing_time").alias("tgt_t"), _seconds("response_processing_time").alias("resp_t"),
        F.col("received_bytes").try_cast("bigint").alias("rx"), F.col("sent_bytes").try_cast("bigint").alias("tx"),
        _dash("user_agent").alias("user_agent"), _dash("error_reason").alias("error_reason"),
        _dash("classification").alias("classification"),
        _dash("classification_reason").alias("classification_reason"), _dash("actions_executed").alias("actions"),
        _dash("elb_error_code").alias("elb_error_code"), _dash("target_error_code").alias("target_error_code"),
        _dash("trace_id").alias("trace_id"), F.col("type"), _dash("ssl_protocol").alias("ssl_protocol"),
        _dash("matched_rule_priority").alias("rule_priority"),
        _dash("request_creation_time").alias("request_created"), _dash("target_port_list").alias("target_list"),
        _dash("target_status_code_list").alias("target_code_list"), "raw")
    return (with_url_parts(parsed).withColumn("cluster", web.cluster_of(F.col("tg"))).select(*P.REQUEST_COLUMNS))


def with_url_parts(requests: DataFrame, url: str = "url") -> DataFrame:
    """Path, grouped path and query of a URL column."""
    return (requests.withColumn("path", web.url_path(F.col(url)))
            .withColumns({"path_group": web.path_group(F.col("path")), "query": web.url_query(F.col(url))}))


def _rollup(requests: DataFrame, keys: list[str]) -> DataFrame:
    return (requests.groupBy(floor_to("ts_ms", MINUTE).alias("minute_ms"), *keys,
                             web.latency_bin("tgt_t").alias("lat_bin"))
            .agg(F.count("*").alias("n"), F.sum("tgt_t").alias("tgt_t_sum"), F.count("tgt_t").alias("tgt_t_n")))


def minute_rollup(requests: DataFrame) -> DataFrame:
    """Requests per minute, balancer, target group, domain, codes and latency bin."""
    return _rollup(requests, P.MINUTE_KEYS)


def path_rollup(requests: DataFrame) -> DataFrame:
    """The same per method and grouped path, without the domain."""
    return _rollup(requests, P.PATH_KEYS)


def coarser(rollup: DataFrame, step: int) -> DataFrame:
    """A roll-up in longer steps (hours, days): the same keys and sums, ``minute_ms`` being the start of the step."""
    sums = ["n", "tgt_t_sum", "tgt_t_n"]
    keys = [c for c in rollup.columns if c not in ("minute_ms", *sums)]
    return rollup.groupBy(floor_to("minute_ms", step).alias("minute_ms"), *keys).agg(*[F.sum(c).alias(c) for c in sums])


def parse_access_key(files: DataFrame, path: str = "path") -> DataFrame:
    """Account, region, balancer, end time and hour of access log files; other files are left out.

    A file covers the five minutes before its end time, so its hour is that of one minute earlier.
    """
    name = F.regexp_extract(path, r"[^/]*$", 0)
    end = F.try_to_timestamp(F.regexp_extract(name, P.ACCESS_FILE, 5), F.lit("yyyyMMdd'T'HHmmX"))
    return (files.filter(name.rlike(P.ACCESS_FILE))
            .withColumns({"account": F.regexp_extract(name, P.ACCESS_FILE, 1),
                          "region": F.regexp_extract(name, P.ACCESS_FILE, 2),
                          "lb": F.regexp_extract(name, P.ACCESS_FILE, 3), "end_ms": F.unix_millis(end)})
            .withColumn("hour_ms", floor_to(F.col("end_ms") - MINUTE, 60 * MINUTE)))
