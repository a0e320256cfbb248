"""Texts of several languages in the pipeline's first stage."""

from pyspark.sql import functions as F

from storegrain.llm import langid
from storegrain.llm.common import held_out


def test_an_evenly_mixed_text_stays(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    longest = {r["lang"]: r["text"].split() for r in docs.groupBy("lang").agg(F.max_by("text", F.struct("n_chars", "doc_id")).alias("text")).filter("lang is not null").collect()}
    text = " ".join(w for lang in sorted(longest) for w in longest[lang][:60])
    new = spark.createDataFrame([(-1, text, None, "mixed", len(text)), (-2, "12 34 -- 56", None, "none", 11), (-3, None, None, "none", 0)], docs.schema)
    with_new = docs.unionByName(new)
    model = langid.train(with_new.filter(~held_out(F.col("doc_id"))))
    score = langid.identify(new, model).filter("doc_id = -1").first()["score"]
    assert len(longest) == 4 and 0.2 < score < 0.3
    kept = {r["doc_id"] for r in P.language_id(spark, with_new, sf_dir).filter("doc_id < 0").collect()}
    assert kept == {-1}
