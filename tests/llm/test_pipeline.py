"""The pipeline's stages one after the other, and what each must keep."""

import hashlib

from pyspark.sql import functions as F


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    columns = docs.columns
    rows = docs
    for name, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        rows = spark.createDataFrame(rows.collect(), docs.schema)
        assert rows.columns == columns, name
        seen.append(rows.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4]
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.run(spark, sf_dir).collect()}
    assert whole.keys() == {r.doc_id for r in rows.select("doc_id").collect()}
    last = P.STAGES[-1][1](spark, rows, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in last} == whole
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in last)


def test_stages_take_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline as P

    rows = odd.withColumn("doc_id", F.col("doc_id"))
    assert P.secrets(spark, rows, sf_dir).count() == 10 and P.byte_bpe(spark, rows, sf_dir).count() == 10
    assert P.language(spark, rows, sf_dir).columns == rows.columns
    assert P.decontamination(spark, rows, sf_dir).columns == rows.columns
    for _, stage in P.STAGES:
        assert stage(spark, rows.limit(0), sf_dir).count() == 0


def test_stages_keep_columns_of_their_own_names(spark, sf_dir, odd):
    import corpus_pipeline as P

    named = odd.withColumns({"__language": F.lit(1), "__leaks": F.lit(2), "__leaks_0": F.lit(3)})
    for stage in (P.language, P.decontamination, P.near_duplicates):
        out = stage(spark, named, sf_dir)
        assert out.columns == named.columns
        assert {(r["__language"], r["__leaks"], r["__leaks_0"]) for r in out.collect()} <= {(1, 2, 3)}
