"""Inputs that grow in one place: many languages, long hosts, common windows, labels given twice."""

import time

import numpy as np
from pyspark.sql import functions as F

from storegrain.llm import decontaminate, langid, quality, urls


def plain_path(s, penalty):
    """The best path by one pass over the words."""
    best, back = np.zeros(s.shape[1]), []
    for row in s:
        jump = best.max() - penalty
        back.append(np.where(best >= jump, np.arange(len(best)), best.argmax()))
        best = np.maximum(best, jump) + row
    path = [int(best.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return path[::-1] if len(s) else []


def test_paths_of_many_languages():
    rng = np.random.default_rng(4)
    for n_states in (1, 2, 16, 17, 127, 129, 300, 1000):
        scores = [np.where(rng.random((n, n_states)) < 0.1, 0, -rng.random((n, n_states)) * 6) for n in (0, 1, 3, 40, 700)]
        assert [p.tolist() for p in langid.viterbi(scores, 4.0)] == [plain_path(s, 4.0) for s in scores]


def test_three_hundred_labels_and_more(spark, monkeypatch):
    names = [f"l{k:03d}" for k in range(320)]
    word = lambda k: "".join(chr(97 + (k // 18**i + 5 * i) % 18) for i in range(6))
    rows = [(j * 1000 + k, f"{word(31 * k + 1)} {word(977 * k + 13)} {word(31 * k + 1)}", x) for k, x in enumerate(names) for j in range(2 if k < 300 else 1)]
    model = langid.train(spark.createDataFrame(rows * 3, "doc_id long, text string, lang string"))
    assert model["langs"] == names[:300]  # the others have fewer rows
    said = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([r[:2] for r in rows[:400]], "doc_id long, text string"), model).collect()}
    assert np.mean([said[d] == x for d, _, x in rows[:400]]) > 0.95


def test_a_host_of_many_labels(spark):
    long = "a." * 100_000 + "bad.example"
    rows = [(1, f"http://{long}/x/1"), (2, f"http://{long}./x"), (3, "http://" + "b" * 300_000 + "/x"), (4, "http://xbad.example/x"), (5, "http://bad.example/x"), (6, "http://.bad.example/x")]
    u = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("bad.example", "/x", "block"), ("example", "/", "allow")], "host string, path string, verdict string")
    began = time.time()
    for most in (2_000_000, 0):
        got = {r["page_id"]: r["rule"] for r in urls.judge(u, rules, most_rules=most).collect()}
        assert got == {1: "bad.example/x", 2: None, 3: None, 4: "example/", 5: "bad.example/x", 6: "bad.example/x"}
    assert time.time() - began < 60


def test_a_window_of_very_many_items(spark):
    bench = spark.createDataFrame([(f"i{k}", "the") for k in range(10_000)] + [(None, "the"), ("j", "the the")], "item_id string, text string")
    docs = spark.createDataFrame([(k, "the " * 2_000) for k in range(4)] + [(9, "none")], "doc_id long, text string")
    began = time.time()
    for bound in (64 << 20, 0):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], len(r["items"])) for r in decontaminate.contamination(docs, bench, broadcast_bytes=bound).collect()}
        assert got == {k: (2_000, 2_000, 10_002, 10_001) for k in range(4)} | {9: (1, 0, 0, 0)}
    assert time.time() - began < 90


def test_labels_given_twice(spark):
    docs = spark.createDataFrame([(3, "good"), (3, "good too"), (5, "bad"), (8, "open"), (None, "none")], "doc_id long, text string")
    known = [d for d in (3, 5, 8) if docs.filter(F.col("doc_id") == d).filter(quality.held_out(F.col("doc_id"))).count() == 0]
    labels = spark.createDataFrame([(3, 1)] * 50 + [(5, 0), (5, 0), (8, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["text"], r["label"]) for r in quality.labelled_rows(docs, labels).collect())
    assert got == [x for x in [(3, "good", 1), (3, "good too", 1), (5, "bad", 0)] if x[0] in known]
    many = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("good words "), F.when(F.col("id") < 5, F.col("id")).cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("label"))
    assert np.isfinite(quality.train(many, bound=50)["bias"])


def test_very_long_texts_in_every_stage(spark, sf_dir):
    """A text of 150,000 words in many lines, and one of a single line, next to short ones."""
    import corpus_pipeline as P

    rng = np.random.default_rng(9)
    words = np.array(["the", "und", "maison", "house", "Weg", "chemin", "water", "wasser"])
    long = "\n".join(" ".join([*rng.choice(words, 30), str(k)]) for k in range(5_000))
    line = " ".join(f"{w} {k}" for k, w in enumerate(rng.choice(words, 150_000)))
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = [(10**6, long, "en", "s", len(long)), (10**6 + 1, long + " end", "en", "s", len(long)), (10**6 + 2, line, None, "s", len(line))]
    docs = few.unionByName(spark.createDataFrame(more, few.schema))
    for _, stage in P.STAGES:
        docs = P.landed(stage(spark, docs, sf_dir), "stage")
    got = {r["doc_id"]: r["n_tokens"] for r in docs.filter("doc_id >= 1000000").collect()}
    assert got.keys() == {10**6, 10**6 + 2} and min(got.values()) > 150_000
