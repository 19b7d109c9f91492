"""The pipeline's stages against brute force, each on its own input."""
import re

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from opslens.llm import near_dedup, sql

from odd import no_docs, odd_docs, odd_rows  # noqa: F401, I001

SMALL = "/root/testdata/sf0.001"


def test_stages_on_given_rows(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        seen[name] = (docs, docs := spark.read.parquet(path))
        assert docs.columns == (columns if name != "mixing" else [*columns, "copies"])
    rows = {n: [[(r.doc_id, r.text) for r in df.collect()] for df in pair] for n, pair in seen.items()}
    before, after = rows["language_id"]
    assert set(after) == {x for x in before if re.search(r"[^\W\d_]", x[1] or "")}
    before, after = rows["exact_dedup"]
    assert sorted(after) == sorted((max(d for d, t in before if t == text), text) for text in {t for _, t in before})
    before, after = rows["near_dedup"]
    heads = near_dedup.brute_force(before)
    assert sorted(d for d, _ in after) == sorted({heads[d] for d, _ in before})
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{SMALL}/benchmark.parquet'")
    con.register("documents", seen["decontamination"][0].toArrow())
    found = {r[0] for r in con.execute(sql.DECONTAMINATION).fetchall()}
    before, after = rows["decontamination"]
    assert sorted(after) == sorted(x for x in before if x[0] not in found) and found
    con.unregister("documents")
    con.register("documents", seen["mixing"][0].toArrow())
    taken = {r[0]: r[4] // r[1] for r in con.execute(sql.MIXING).fetchall() if r[4]}
    assert {r.doc_id: r.copies for r in seen["mixing"][1].collect()} == taken


def test_odd_rows_pass_through(spark, odd_docs, no_docs, tmp_path):
    for kind, docs in (("odd", odd_docs), ("none", no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / kind / name)
            stage(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns == [*odd_docs.columns, "copies_"]
        left = [r.text for r in docs.collect()]
        assert len(left) == len(set(left)) and set(left) <= {t for _, t, *_ in odd_rows()} and bool(left) == (kind == "odd")
    assert docs.where(F.col("copies_") < 1).count() == 0
