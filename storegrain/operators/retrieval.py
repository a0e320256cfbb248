"""Policy passages: packing, retrieval by vectors, reuse of verdicts, and accuracy against labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.sources.tables import landed, merge_buckets

LEAST_CHARS, CHUNK_CHARS, CACHE_DAYS = 40, 1200, 30
#: Bytes of the vectors of a block of queries and of chunks at most, the queries and the pairs that are scored at once, and bits of the filter of quotes.
QUERY_BYTES, CHUNK_BYTES, TILE, PAIRS, BITS = 16 << 20, 2 << 20, 256, 1 << 16, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def _plain(v: Column) -> Column:
    """Whether a vector holds numbers only, of which squares neither overflow nor vanish."""
    return F.forall(v, lambda x: F.coalesce((F.abs(x) < 1e100) & ((x == 0) | (F.abs(x) > 1e-100)), F.lit(False)))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _best_of_block(queries: pa.Table, chunks: pa.Table, top: int, columns: list[str]) -> pa.Table:
    """The best chunk of each of the best `top` sections of a block of chunks for each of a block of queries, all vectors plain and of one width.

    Products of whole blocks tell the few pairs that may be among these; their scores are then summed up in the order of `dot`.
    """
    def rows(r: np.ndarray, i: np.ndarray, score: np.ndarray) -> pa.Table:
        found = {"query_id": queries["query_id"].take(pa.array(r)), "score": pa.array(score)}
        return pa.table({c: found[c] if c in found else chunks[c].take(pa.array(i)) for c in columns})

    if not queries.num_rows or not chunks.num_rows:
        return rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    key = lambda i: tuple((x is not None, x or "") for x in (urls[i], sections[i]))
    urls, sections = chunks["source_url"].to_pylist(), chunks["section"].to_pylist()
    chunks = chunks.take(sorted(range(len(urls)), key=key))
    urls, sections = chunks["source_url"].to_pylist(), chunks["section"].to_pylist()
    new = np.array([i == 0 or key(i) != key(i - 1) for i in range(len(urls))])
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    q, c, index = _matrix(queries["vector"]), _matrix(chunks["chunk_vector"]), chunks["chunk_index"].cast(pa.int64()).fill_null(2**63 - 1).to_numpy()

    def length(v: np.ndarray) -> np.ndarray:
        return np.sqrt(summed(v, v))

    def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        return total

    q_length, c_length = length(q), length(c)
    unit = lambda v, n: v / np.where(n == 0, 1.0, n)[:, None]
    q_unit, c_unit, slack = unit(q, q_length), unit(c, c_length).T.copy(), 8 * (q.shape[1] + 8) * np.finfo(float).eps
    first = np.lexsort((index, of))[starts]  # the least chunk_index of each section, for queries without a length
    found = []
    for at in range(0, len(q), TILE):
        near = q_unit[at : at + TILE] @ c_unit
        best = np.maximum.reduceat(near, starts, axis=1)
        least = np.partition(best, -top, axis=1)[:, -top] if best.shape[1] > top else np.full(len(best), -np.inf)
        some = q_length[at : at + TILE] > 0
        r, i = np.nonzero((near >= (least - slack)[:, None]) & some[:, None])
        keep = near[r, i] >= best[r, of[i]] - slack
        zero = np.flatnonzero(~some)
        r, i = np.concatenate([r[keep], np.repeat(zero, len(first))]), np.concatenate([i[keep], np.tile(first, len(zero))])
        n, score = q_length[at + r] * c_length[i], np.empty(len(r))
        for k in range(0, len(r), PAIRS):
            score[k : k + PAIRS] = summed(q[at + r[k : k + PAIRS]], c[i[k : k + PAIRS]])
        score = np.where(n == 0, 0.0, score / np.where(n == 0, 1.0, n))
        # the best chunk of each section, then the best sections of each query
        order = np.lexsort((index[i], -score, of[i], r))
        r, i, score = r[order], i[order], score[order]
        one = np.flatnonzero(np.diff(r, prepend=-1).astype(bool) | np.diff(of[i], prepend=-1).astype(bool))
        r, i, score = r[one], i[one], score[one]
        order = np.lexsort((of[i], -score, r))
        r, i, score = r[order], i[order], score[order]
        begin = np.flatnonzero(np.diff(r, prepend=-1))
        rank = np.arange(len(r)) - np.repeat(begin, np.diff(begin, append=len(r)))
        found.append((at + r[rank < top], i[rank < top], score[rank < top]))
    return rows(*map(np.concatenate, zip(*found, strict=True)))


def best_passages(queries: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, rank, source_url, section, score, chunk_index[, created_at]): the best chunk of each section of the query's policy, then the top sections.

    queries: query_id, policy_id, vector. chunks: policy_id, source_url, section, chunk_index, vector[, created_at].
    Every query of a policy meets every chunk of it: blocks of both, sized by their counted bytes, form a grid of cells, each of
    which gives a query's best `top` sections. So a query is shuffled once for each block of chunks, and a chunk once for each
    block of queries. Equal vectors of a section come down to the least chunk_index. Pairs with a vector that has nulls, no finite
    numbers or another width are joined one by one.
    """
    more = [c for c in ("created_at",) if c in chunks.columns]
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    of = ["policy_id", "source_url", "section"]
    c = chunks.groupBy(*of, "vector").agg(F.max(F.struct((-F.col("chunk_index")).alias("i"), *more)).alias("b"))
    c = c.select(*of, (-F.col("b.i")).alias("chunk_index"), double("vector").alias("chunk_vector"), *[F.col(f"b.{m}") for m in more])
    c = landed(c.withColumns({"plain": F.coalesce(_plain(F.col("chunk_vector")), F.lit(False)), "width": F.size("chunk_vector")}), "chunks")
    q = queries.select("query_id", "policy_id", double("vector").alias("vector"))
    q = landed(q.withColumns({"plain": F.coalesce(_plain(F.col("vector")), F.lit(False)), "width": F.size("vector")}), "queries")
    count = lambda t: t.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(0)), F.count_if(~F.col("plain")), F.coalesce(F.min("width"), F.lit(0))).first()
    (n_q, wide_q, odd_q, least_q), (n_c, wide_c, odd_c, least_c) = count(q), count(c)
    across = lambda n, width, most: max(1, -(-n * max(width, 1) * 8 // most))
    n_x, n_y = across(n_q, wide_q, QUERY_BYTES), across(n_c, wide_c, CHUNK_BYTES)
    cell = ["policy_id", "width", "x", "y"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda t, n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    fits = F.col("plain") & (F.col("width") > 0)
    left = q.filter(fits).select("query_id", "vector", "policy_id", "width", dealt(q, n_x, "query_id", "vector").alias("x"), every(n_y).alias("y"))
    right = c.filter(fits).select("source_url", "section", "chunk_index", "chunk_vector", *more, "policy_id", "width", dealt(c, n_y, "source_url", "section", "chunk_vector").alias("y"), every(n_x).alias("x"))
    candidate = ["query_id", "source_url", "section", "score", "chunk_index", *more]
    schema = left.crossJoin(right.select("source_url", "section", "chunk_index", *more)).withColumn("score", F.lit(0.0)).select(*candidate).schema
    n_cells = 2 * n_x * n_y
    by_cell = lambda t: t.repartition(n_cells, *cell).groupBy(*cell)
    best = by_cell(left).cogroup(by_cell(right)).applyInArrow(lambda a, b: _best_of_block(a, b, top, candidate), schema)
    scored = lambda a, b: a.join(b.drop("plain", "width"), "policy_id").withColumn("score", cosine(F.col("vector"), F.col("chunk_vector"))).select(*candidate)
    if odd_q or wide_q == 0 or least_q <= 0:
        best = best.unionByName(scored(q.filter(~fits), c))
    if odd_c or least_c <= 0:
        best = best.unionByName(scored(q.filter(fits), c.filter(~fits)))
    if min(least_q, least_c) < max(wide_q, wide_c):
        # vectors of unlike width have no score; a section without any other is named by its first chunk
        firsts = c.filter(fits).groupBy(*of, F.col("width").alias("w")).agg(F.max(F.struct((-F.col("chunk_index")).alias("i"), *more)).alias("b"))
        none = q.filter(fits).join(firsts, "policy_id").filter(F.col("w") != F.col("width"))
        best = best.unionByName(none.select("query_id", "source_url", "section", F.lit(None).cast("double").alias("score"), (-F.col("b.i")).alias("chunk_index"), *[F.col(f"b.{m}") for m in more]))
    best = best.groupBy("query_id", "source_url", "section").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("i"), *more)).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b.score"), "source_url", "section")
    out = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.select("query_id", "rank", "source_url", "section", F.col("b.score").alias("score"), (-F.col("b.i")).alias("chunk_index"), *[F.col(f"b.{m}") for m in more])


def context(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, text, oldest): the texts of the chosen chunks (of best_passages) joined by rank, and the oldest created_at of them."""
    t = chunks.select("source_url", "section", "chunk_index", "chunk_text")
    j = best.join(t, ["source_url", "section", "chunk_index"])
    oldest = F.min("created_at") if "created_at" in best.columns else F.min(F.lit(None).cast("timestamp"))
    return j.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"]), "\n\n").alias("text"), oldest.alias("oldest"))


def packed(sections: DataFrame) -> DataFrame:
    """(id, chunk_index, chunk_text): the sentences of each section text packed to at most CHUNK_CHARS; sections under LEAST_CHARS are left out. A longer sentence is a chunk of its own."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    s = sections.withColumn("t", text).filter(F.char_length("t") >= LEAST_CHARS)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, x):
        fits = F.char_length(acc["open"]) + F.char_length(x) + 1 <= CHUNK_CHARS
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), x.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), x).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open")))

    chunks = F.aggregate(F.split("t", r"(?<=[.!?]) "), zero, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return s.select("id", F.posexplode(chunks).alias("chunk_index", "chunk_text"))


def rebuilt(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the policies in new, and those of old for policies without new ones."""
    return new.unionByName(old.join(new.select("policy_id").distinct(), "policy_id", "left_anti"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (cache_key, result_json, created_at) with new entries: the newest of each key."""
    return cache.unionByName(new).groupBy("cache_key").agg(F.max_by(F.struct("result_json", "created_at"), "created_at").alias("r")).select("cache_key", "r.*")


def store_verdicts(new: DataFrame, path: str, buckets: int = 64) -> None:
    """upserted on the table at path (of write_buckets by cache_key): only the folders of new keys are read and written."""
    merge_buckets(new, path, ["cache_key"], lambda old, fresh: upserted(old, fresh.select(*old.columns)), buckets)


def reuse(work: DataFrame, cache: DataFrame, now: Column, changes: DataFrame | None = None) -> DataFrame:
    """work (cache_key[, policy_id], ..) with result_json and hit: its newest entry by then, if that is CACHE_DAYS old at most, to the second,
    and newer than the last change of its policy by then.

    now: when a row of work asks, a column of it or a constant. changes: policy_id, changed_at; whatever comes after a row asks
    doesn't count, and without changes no entry is outdated. Both as-of joins go through equal asks once: entries and asks of a
    key are put in order and the last entry is carried forward; a policy's changes are few and travel as one sorted array.
    """
    on = ["cache_key"] + ["policy_id"] * (changes is not None)
    asked = work.withColumn("asked_at", now.cast("timestamp"))
    asks = asked.select(*on, "asked_at").distinct()
    if changes is not None:
        known = changes.groupBy("policy_id").agg(F.sort_array(F.collect_set("changed_at")).alias("changed"))
        asks = asks.join(known, "policy_id", "left").withColumn("changed", F.array_max(F.filter("changed", lambda t: t <= F.col("asked_at"))))
    else:
        asks = asks.withColumn("changed", F.lit(None).cast("timestamp"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    entries = cache.select("cache_key", F.col("created_at").alias("at"), F.struct(F.col("created_at").alias("at"), "result_json").alias("entry"), F.lit(0).alias("side"), *[none(c, asks.schema[c].dataType) for c in [*on[1:], "changed"]])
    both = entries.unionByName(asks.select("cache_key", F.col("asked_at").alias("at"), none("entry", entries.schema["entry"].dataType), F.lit(1).alias("side"), *on[1:], "changed"))
    w = Window.partitionBy("cache_key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("entry", F.last("entry", ignorenulls=True).over(w)).filter("side = 1").withColumnRenamed("at", "asked_at")
    young = F.col("entry.at") >= F.col("asked_at") - F.make_dt_interval(F.lit(CACHE_DAYS))
    found = found.filter(young & (F.col("changed").isNull() | (F.col("entry.at") > F.col("changed")))).select(*on, "asked_at", F.col("entry.result_json").alias("result_json"))
    return asked.join(found, [*on, "asked_at"], "left").withColumn("hit", F.col("result_json").isNotNull()).drop("asked_at")


def accuracy(verdicts: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Per category: tp, fp, tn, fn, excluded, precision, recall. labels.verdict in pass, fail and others, which are excluded; a missing verdict is a pass."""
    j = labels.withColumnRenamed("verdict", "truth").join(verdicts, by, "left").withColumn("said", F.coalesce("verdict", F.lit("pass")))
    n = lambda said, truth: F.count_if((F.col("said") == said) & (F.col("truth") == truth))
    out = j.groupBy("category").agg(n("fail", "fail").alias("tp"), n("fail", "pass").alias("fp"), n("pass", "pass").alias("tn"), n("pass", "fail").alias("fn"), F.count_if(~F.col("truth").isin("pass", "fail")).alias("excluded"))
    return out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def _places(m: int, cells: list[int]) -> Column:
    """(at, m) of the places in the words `ws` whose first m words have their bit set among cells."""
    bits = [0] * (BITS // 32)
    for c in cells:
        bits[c >> 5] |= 1 << (c & 31)
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def may(i: Column) -> Column:
        cell = F.pmod(F.xxhash64(F.slice("ws", i, m)), F.lit(BITS)).cast("int")
        return F.get(table, F.shiftright(cell, 5)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(31)))) != 0

    found = F.transform(F.filter(F.sequence(F.lit(1), F.size("ws") - m + 1), may), lambda i: F.struct(i.alias("at"), F.lit(m).alias("m")))
    return F.when(F.size("ws") >= m, found).otherwise(F.array().cast("array<struct<at:int,m:int>>"))


def quotes_found(texts: DataFrame, quotes: DataFrame, words: int = 8) -> DataFrame:
    """(quote_id, n_texts): texts that hold a quote word by word.

    The first `words` words of each place in a text are tested inside its row against a bitmap of the quotes' first
    words, of fixed size; the few places that pass carry as many words as the longest quote has, so no text is joined.
    """
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    q = quotes.select("quote_id", split(F.col("text")).alias("q")).filter(F.size("q") > 0).withColumn("n", F.size("q"))
    q = q.withColumn("m", F.least(F.lit(words), "n")).withColumn("head", F.xxhash64(F.slice("q", F.lit(1), F.col("m"))))
    known = q.groupBy("m").agg(F.max("n").alias("longest"), F.collect_set(F.pmod("head", F.lit(BITS))).alias("cells")).collect()  # `words` rows of BITS cells at most
    place = "array<struct<at:int,m:int>>"
    starts = F.array().cast(place)
    t = texts.select("text_id", split(F.col("text")).alias("ws"))
    for r in known:
        starts = F.concat(starts, _places(r["m"], r["cells"]).cast(place))
    longest = max((r["longest"] for r in known), default=1)
    s = t.withColumn("s", F.explode(starts)).select("text_id", F.xxhash64(F.slice("ws", F.col("s.at"), F.col("s.m"))).alias("head"), F.slice("ws", F.col("s.at"), F.lit(longest)).alias("here"))
    hit = s.join(q, "head").filter(F.slice("here", F.lit(1), F.col("n")) == F.col("q"))
    n = hit.select("quote_id", "text_id").distinct().groupBy("quote_id").agg(F.count(F.lit(1)).alias("n_texts"))
    return quotes.select("quote_id").join(n, "quote_id", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0).cast("long")))
