"""Error lines grouped by kind."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions import text as X
from ..session import stored

KIND = ["exception", "key"]


class Cut(NamedTuple):
    """What a screen shows of long lines; nothing is cut unless asked for."""
    first_line: bool = False
    line_chars: int | None = None
    normalized_chars: int | None = None
    variants: int = 0


def error_lines(logs: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """(exception, key, normalized, line, service, location, store, tenant) of every log line."""
    have = set(logs.columns)

    def optional(name: str) -> Column:
        return X.trimmed(name) if name in have else F.lit(None).cast("string")
    said = [c for c in ("msg", "body", "raw") if c in have]
    line = X.grouping_line(X.first_text(said), cut.first_line, cut.line_chars) if said else F.lit("")
    # never NULL, which tells Spark that joins on the key need no filter and may share one pass
    line = F.coalesce(line, F.lit(""))
    location = X.code_location(*[F.col(c) if c in have else None for c in ("class", "method", "line")])
    service = F.col("service").cast("string") if "service" in have else F.lit(None).cast("string")
    return (logs.select(F.coalesce(optional("exception"), F.lit("")).alias("exception"), line.alias("text"),
                        service.alias("service"), location.alias("location"),
                        optional("tenant_id").alias("tenant_column"))
            .select("exception", "text", "service", "location", X.normalize_error(F.col("text"), cut.normalized_chars).alias("normalized"),
                    X.store_in(F.col("text")).alias("store"),
                    F.coalesce("tenant_column", X.tenant_in(F.col("text"))).alias("tenant"))
            .withColumn("key", X.error_key(F.col("normalized"))))


def templates(variants: DataFrame) -> DataFrame:
    """KIND, error and n_variants from the distinct normalised lines of each kind.

    Lines of as many words: words that differ become ``<*>``. Otherwise the first and last words that all share, around an
    ellipsis. Kinds of several lines compare each with one of them, that of the smallest hash: how many words both begin and
    end with, or which differ. Only those numbers meet per kind, neither the lines nor their words.
    """
    line, smallest, mark = F.split("normalized", " ", -1), F.split("smallest", " ", -1), F.xxhash64("normalized")
    refs = variants.groupBy(*KIND).agg(F.count("*").alias("n_variants"), F.min("normalized").alias("smallest"),
                                       F.min(F.size(line)).alias("shortest"), F.max(F.size(line)).alias("longest"), F.min(mark).alias("mark"))
    several = refs.filter(F.col("n_variants") > 1)
    # "<=" and not "==", which would be one more key to shuffle the lines by
    chosen = variants.join(several.select(*KIND, "mark"), KIND).filter(mark <= F.col("mark")).select(*KIND, F.col("normalized").alias("other"))
    aligned = F.col("shortest") == F.col("longest")
    pairs = (variants.join(several.select(*KIND, aligned.alias("aligned")), KIND).join(chosen, KIND)
             .select(*KIND, "aligned", (F.col("normalized") == F.col("other")).alias("own"), line.alias("words"), F.split("other", " ", -1).alias("others")))
    # the line compared with brings every position, the others those that differ
    compared = F.transform(F.zip_with("words", "others", lambda a, b: a != b), lambda x, i: F.struct(i.alias("spot"), x.alias("differs")))
    brought = F.filter(compared, lambda s: s["differs"] | F.col("own"))
    found = pairs.select(*KIND, F.when(~F.col("aligned"), X.shared_words(F.col("words"), F.col("others"))).alias("ahead"),
                         F.when(~F.col("aligned"), X.shared_words(F.reverse("words"), F.reverse("others"))).alias("behind"),
                         F.explode_outer(F.when(F.col("aligned"), brought)).alias("s"))
    shared = (found.groupBy(*KIND, F.col("s.spot").alias("spot")).agg(F.max("s.differs").alias("differs"), F.min("ahead").alias("ahead"), F.min("behind").alias("behind"))
              .groupBy(*KIND).agg(F.min("ahead").alias("ahead"), F.min("behind").alias("behind"),
                                  F.array_sort(F.collect_list(F.struct("spot", "differs"))).alias("spots")))
    marked = F.zip_with(smallest, F.col("spots"), lambda w, s: F.when(s["differs"], "<*>").otherwise(w))
    same = F.regexp_replace(F.array_join(marked, " "), P.REPEATED_WILDCARD, "<*>")
    head = F.least("ahead", "shortest")
    tail = F.least(F.col("behind"), F.col("shortest") - head)
    last = F.array_join(F.reverse(F.slice(F.reverse(smallest), F.lit(1), tail)), " ")
    around = F.trim(F.concat(F.array_join(F.slice(smallest, F.lit(1), head), " "), F.lit(" …"), F.when(tail > 0, F.concat(F.lit(" "), last)).otherwise("")))
    error = F.when(F.col("n_variants") == 1, F.col("smallest")).when(aligned, same).otherwise(around)
    return refs.join(shared, KIND, "left").select(*KIND, error.alias("error"), "n_variants")


def _summed(lines: DataFrame) -> DataFrame:
    """All that one pass over the lines tells of each kind."""
    return lines.groupBy(*KIND).agg(
        F.count("*").alias("n"), F.min("text").alias("example"), F.min("service").alias("service"), F.sort_array(F.collect_set("store")).alias("stores"),
        F.sort_array(F.collect_set("tenant")).alias("tenants"), F.mode("location", True).alias("location"))


def _detailed(kinds: DataFrame, variants: DataFrame, cut: Cut) -> DataFrame:
    """``kinds`` with their template, from the distinct normalised lines of those kinds only."""
    found = kinds.join(templates(variants), KIND)
    if cut.variants:
        first = W.partitionBy(*KIND).orderBy("normalized")
        few = variants.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= cut.variants)
        found = found.join(few.groupBy(*KIND).agg(F.sort_array(F.collect_list("normalized")).alias("variants")), KIND)
    return found


def _variants(lines: DataFrame) -> DataFrame:
    return lines.select(*KIND, "normalized").distinct()


def error_kinds(logs: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """One row per kind: n, example, service, stores, tenants, location, the template and the number of variants (and ``cut.variants`` of them).

    Lines are summed up and made distinct in each task first, so a kind that holds most of the lines is already small when its
    rows come together. Picks that could go either way take the smallest value.
    """
    lines = error_lines(logs, cut)
    return _detailed(_summed(lines), _variants(lines), cut)


def _tallied(lines: DataFrame) -> DataFrame:
    """One row for each variant of a kind and place in the code, with all that its lines tell."""
    return lines.groupBy(*KIND, "normalized", "location").agg(
        F.count("*").alias("n"), F.min("text").alias("example"), F.min("service").alias("service"),
        F.collect_set("store").alias("stores"), F.collect_set("tenant").alias("tenants"))


def _summed_tallies(tallies: DataFrame) -> DataFrame:
    """What ``_summed`` gives, from tallies."""
    def every(names: str, name: str) -> DataFrame:
        return tallies.select(*KIND, F.explode(names).alias(name)).groupBy(*KIND).agg(F.sort_array(F.collect_set(name)).alias(names))
    often = F.when(F.col("location").isNotNull(), F.struct(-F.col("n"), "location"))
    sums = (tallies.groupBy(*KIND, "location").agg(F.sum("n").alias("n"), F.min("example").alias("example"), F.min("service").alias("service"))
            .groupBy(*KIND).agg(F.sum("n").alias("n"), F.min("example").alias("example"), F.min("service").alias("service"),
                                F.min_by("location", often).alias("location")))
    none = F.array().cast("array<string>")
    return (sums.join(every("stores", "store"), KIND, "left").join(every("tenants", "tenant"), KIND, "left")
            .select(*KIND, "n", "example", "service", F.coalesce("stores", none).alias("stores"), F.coalesce("tenants", none).alias("tenants"), "location"))


def error_groups(logs: DataFrame, limit: int | None = 200, cut: Cut = Cut()) -> DataFrame:
    """The ``limit`` most frequent kinds (None: all), with the number of kinds and lines over all of them.

    Kinds are ranked by their counts first; only those shown have their variants compared. For a limited list lines are read
    once: their tallies, a row for each variant and place, are written to the shared folder and all else comes from them.
    """
    lines = error_lines(logs, cut)
    order = [F.desc("n"), "key", "exception"]
    if limit is None:
        top = sums = _summed(lines)
        variants = _variants(lines)
    else:
        tallies = stored(_tallied(lines), "tallies")
        sums = _summed_tallies(tallies)
        top = sums.orderBy(*order).limit(limit)
        variants = _variants(tallies).join(top.select(*KIND), KIND, "left_semi")
    totals = sums.agg(F.struct(F.count("*").alias("kinds"), F.sum("n").alias("total")))
    return (_detailed(top, variants, cut).orderBy(*order).withColumn("overall", totals.scalar())
            .select("*", F.col("overall.kinds").alias("kinds"), F.col("overall.total").alias("total")).drop("overall"))


def without_muted(groups: DataFrame, signatures: list[str]) -> DataFrame:
    """Groups whose example and text mention none of the muted signatures."""
    hit = F.lit(False)
    both = F.concat_ws(" ", "example", "error")
    for s in signatures:
        hit = hit | X.contains_text(both, s)
    return groups.filter(~hit)
