"""Finding secrets: three base rules, and character Markov models over all long tokens.

Two first-order chains, of random strings and of ordinary identifiers, are trained from labelled samples. What speaks
for the first is a token's mean log-likelihood ratio a pair of characters; base spans are scored too, but stay
whatever their score. Everything is a Column expression. Offsets come from the lengths of what lies between and in the
matches, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import constant_array, discarded, held_out, landed, sha256

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is too short fails whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Tokens that the models judge: whole runs of 16 characters and more with a letter, as no ordinary identifier is a number.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
#: Ordinary identifiers that the models learn from: the same in documents without a secret, from 8 characters on.
PLAIN = TOKEN.replace("{16,}", "{8,}")
#: Pairs that a character's row counts as at most, so that neither label's word is final for having more samples.
EVIDENCE = 200
#: Matches that are folded to one array at once.
CHUNK = 256
SPAN = "array<struct<start:int,end:int,rank:int,kind:string,text:string>>"
KINDS = ("assign", "access", "hex", "markov")
#: Mean log-likelihood ratio a pair above which a token counts as random, where held-out samples don't tell.
THRESHOLD = 0.5
#: The quantiles of held-out random and ordinary samples that the threshold lies between, and how near to the former.
QUANTILES, NEARNESS = (0.01, 0.999), 0.75


def _spans(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """All leftmost non-overlapping matches as (start, end, rank, kind, text). guard: false where there can be none.

    An array that grows in a fold is copied at each step, so matches are folded CHUNK at a time: the work is linear
    in their number but for one step a chunk.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("m"), between.alias("b")), lambda x: x["m"].isNotNull())
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["m"].alias("text")))).alias("out"))

    zero = lambda at: F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
    parts = F.aggregate(chunks, F.array(zero(F.lit(0))), lambda acc, c: F.concat(acc, F.array(F.aggregate(c, zero(F.element_at(acc, -1)["at"]), step))))
    return F.when(guard, F.flatten(F.transform(parts, lambda p: p["out"]))).otherwise(F.array().cast(SPAN))


def _has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    value = lambda s: F.regexp_extract(s["text"], ASSIGN, 1)
    return F.concat(
        F.filter(_spans(text, ASSIGN, "assign", _has(low, "passw", "secret", "token", "apikey", "api_key")), lambda s: F.char_length(value(s)) >= 8),
        _spans(text, ACCESS, "access", _has(text, "AKIA")),
        _spans(text, HEX, "hex", F.rlike(text, F.lit(HEX))),
    )


def _pairs(token: Column) -> Column:
    """Code of each pair of neighbouring characters, below 128 * 128; tokens hold ASCII only."""
    return F.transform(F.sequence(F.lit(1), F.char_length(token) - 1), lambda i: F.ascii(F.substr(token, i, F.lit(1))) * 128 + F.ascii(F.substr(token, i + 1, F.lit(1))))


def train_markov(samples: DataFrame, *, alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair, from samples (token, label[, k]): 1 random string, 0 ordinary identifier; k is how often.

    First-order chains with add-alpha smoothing over 96 characters, a character's row counting as EVIDENCE pairs at most. A pair that
    no sample has says nothing: its ratio is 0. The result has 128 * 128 numbers, whatever the samples' count. Equal tokens
    are counted before their pairs are. Without samples of a label all ratios are 0.
    """
    k = F.col("k") if "k" in samples.columns else F.lit(1)
    known = samples.filter("token is not null and label is not null").filter(F.char_length("token") > 1).groupBy("label", "token").agg(F.sum(k).alias("k"))
    counts = known.select("label", "k", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("label", "pair").agg(F.sum("k").alias("k")).collect()  # 2 * 128 * 128 rows at most
    n, rows = {0: {}, 1: {}}, {0: [0] * 128, 1: [0] * 128}
    for r in counts:
        n[r["label"]][r["pair"]] = r["k"]
        rows[r["label"]][r["pair"] >> 7] += r["k"]
    if not n[0] or not n[1]:
        return [0.0] * (128 * 128)

    def p(y: int, i: int) -> float:
        row = rows[y][i >> 7]
        weight = min(row, EVIDENCE)
        return math.log((n[y].get(i, 0) * weight / max(1, row) + alpha) / (weight + 96 * alpha))

    return [p(1, i) - p(0, i) if i in n[0] or i in n[1] else 0.0 for i in range(128 * 128)]


def _value(span: Column) -> Column:
    """Of an assignment what is assigned, else the match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["text"], ASSIGN, 1)).otherwise(span["text"])


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, label, held_out, k) from all the documents: distinct tokens, whether of documents that are held out (crc32 of doc_id mod 3 is 1), and how often.

    Random strings: what the base rules find (of an assignment its value). Ordinary identifiers: tokens of the alphabet that is
    judged, of 8 characters and more, in documents without any match.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(text.alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), base_spans(text).alias("spans"))
    sample = lambda token, label: F.struct(token.alias("token"), F.lit(label).alias("label"))
    secret = F.transform("spans", lambda s: sample(_value(s), 1))
    plain = F.transform(F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)), lambda t: sample(t, 0))
    each = d.select("held_out", F.inline(F.when(F.size("spans") > 0, secret).otherwise(plain)))
    return each.groupBy("token", "label", "held_out").agg(F.count(F.lit(1)).alias("k"))


def mean_ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's pairs; null for tokens of one character."""
    ps = _pairs(token)
    return F.when(F.char_length(token) > 1, F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.get(table, p)) / F.size(ps))


def held_out_scores(samples: DataFrame) -> DataFrame:
    """(token, label, k, score) of distinct held-out samples by models of the others: random strings, and ordinary identifiers of the length that is judged."""
    table = constant_array(train_markov(samples.filter("not held_out")), "double")
    s = samples.filter("held_out").filter(F.char_length("token") >= F.when(F.col("label") == 1, 2).otherwise(16))
    return s.groupBy("token", "label").agg(F.sum("k").alias("k")).select("token", "label", "k", mean_ratio(F.col("token"), table).alias("score"))


def learned_threshold(samples: DataFrame) -> float:
    """Between the low end of what held-out random strings score and the high end of ordinary ones, nearer to the former; THRESHOLD where either is missing or they overlap."""
    low, high = (F.percentile_approx(F.when(F.col("label") == y, F.col("score")), q, 1_000_000) for y, q in zip((1, 0), QUANTILES, strict=True))
    r = held_out_scores(samples).agg(low.alias("low"), high.alias("high")).first()
    if r["low"] is None or r["high"] is None or r["low"] <= r["high"]:
        return THRESHOLD
    return NEARNESS * r["low"] + (1 - NEARNESS) * r["high"]


def held_out_accuracy(docs: DataFrame, *, threshold: float | None = None) -> DataFrame:
    """One row (tp, fn, fp, tn) of the models alone: trained on the documents that aren't held out, they judge the samples of the others, each as often as it is there.

    Base values that the models call random are tp, ordinary tokens of the judged form that they do fp.
    """
    samples = landed(labelled_samples(docs), "secret-samples")
    threshold = learned_threshold(samples) if threshold is None else threshold
    s = held_out_scores(samples).withColumn("said", F.col("score") > threshold)
    n = lambda label, yes: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("said") == F.lit(yes)), F.col("k"))), F.lit(0))
    return s.agg(n(1, True).alias("tp"), n(1, False).alias("fn"), n(0, True).alias("fp"), n(0, False).alias("tn"))


def find_secrets(docs: DataFrame, ratios: list[float], *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) per row of docs: base spans, and tokens whose mean log-likelihood ratio a pair exceeds threshold.

    All whole tokens of 16 characters and more that hold a letter are judged; of those that do exceed it, the ones that touch a base span
    add none. llr of a span is the mean ratio of its value, of base spans too. Null text is empty and has no spans;
    repeated rows give one row each, an empty table none; other columns are not read. Spans are sorted by start, then
    by kind. One pair of characters counts the same wherever it stands.
    """
    table = constant_array(ratios, "double")
    text = F.coalesce("text", F.lit(""))
    tokens = _spans(F.col("text"), TOKEN, "markov", F.rlike("text", F.lit(TOKEN)))
    scored = lambda spans: F.transform(spans, lambda s: s.withField("llr", mean_ratio(_value(s), table)))
    d = docs.select("doc_id", text.alias("text")).select("doc_id", scored(base_spans(F.col("text"))).alias("base"), F.filter(scored(tokens), lambda s: s["llr"] > threshold).alias("tokens"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    both = F.concat("base", F.filter("tokens", free))
    return d.select("doc_id", F.array_sort(both, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by [kind]; of overlapping spans the first stays."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def as_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    samples = landed(labelled_samples(docs), "secret-samples")
    found = find_secrets(docs, train_markov(samples), threshold=learned_threshold(samples))
    discarded(samples)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    llrs = F.array_join(F.transform("spans", lambda s: F.format_number(s["llr"], 3)), " ")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), sha256(as_string(base)).alias("base_sha256"), as_string(F.col("spans")).alias("spans"), llrs.alias("llrs"))
