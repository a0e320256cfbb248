"""The samples that op10's Markov models learn from."""

import random

from pyspark.sql import functions as F

from storegrain.llm import secrets


def test_a_single_secret_among_many_documents_is_learned_from(spark, tmp_path):
    r = random.Random(3)
    value = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400))
    d = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("ordinary-words in identifiers_2 everywhere").alias("text"))
    # a document that a sample of 10,000 by the hash of doc_id leaves out
    at = d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) > 900_000).agg(F.min("doc_id")).first()[0]
    text = F.when(F.col("doc_id") == at, f"password: {value}").when(F.col("doc_id") == at + 1, f"see {value[100:150]} here").otherwise(F.col("text"))
    d.withColumn("text", text).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x["doc_id"]: x["spans"] for x in secrets.op10_secret_scans(spark, str(tmp_path)).filter("spans <> ''").collect()}
    assert rows == {at: "assign:0:410", at + 1: "markov:4:54"}


def test_no_alarm_for_ordinary_identifiers_of_unseen_pairs(spark, sf_dir):
    """Trained on the tables, the models find injected random tokens of the kind they learned, and none of these."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text")
    samples = secrets.labelled_samples(docs).cache()
    ratios, threshold = secrets.train_markov(samples), secrets.learned_threshold(samples)
    r = random.Random(8)
    tokens = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (16, 20, 24, 31) for _ in range(50)]
    plain = ["the-quick-brown-fox-jumps", "user_id=1234567890", "isbn-978-3-16-148410-0", "abcdefghijklmnopqrstuvwxyz", "https-status-code-404-not-found", "2024-05-06T12-30-00Z", "some/path/to/a/long/file"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(plain + tokens)], "doc_id long, text string")
    got = {x["doc_id"]: [s["kind"] for s in x["spans"]] for x in secrets.find_secrets(d, ratios, threshold=threshold).collect()}
    assert not any(got[k] for k in range(len(plain)))
    with_letter = [k for k, t in enumerate(tokens, len(plain)) if not t.isdigit()]
    assert sum(got[k] == ["markov"] for k in with_letter) > 0.95 * len(with_letter)
    seen = secrets.held_out_accuracy(docs).first()
    assert seen["tp"] >= 0.95 * (seen["tp"] + seen["fn"]) > 0 and seen["fp"] == 0
