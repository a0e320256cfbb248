"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from storegrain.llm import bpe, chat, decontaminate, langid, line_dedup, near_dedup, quality, secrets, topk, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 30_000)
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "One line\nTwo lines"), (5, long), (6, long + " end"), (7, "one LINE\t\nTwo lines "), (8, "é É ß 漢字 😀"), (8, "é É ß 漢字 😀"), (None, "no id")]
    rows += [(10 + k, f"shared line\nown {k} {prose(k, 30)}") for k in range(12)]
    # columns whose names operators use inside
    return spark.createDataFrame([(i, t, "x", 1, [1], "en") for i, t in rows], "doc_id long, text string, line string, n_lines int, bands array<int>, lang string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    b = bpe.load(bpe.vocabulary_path())
    r = random.Random(5)
    chars = "aA bΣéÉ'sdtlvem19²½_-.,!?<|endoftext|>\n\tßſİ語한かア😀\u0301\x1c\x85"
    texts = ["", "<|endoftext|>x<|startoftext|>", "can't WE'LL", *("".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(400)), "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert b.encode(text) == ids and b.decode(ids) == t.decode(ids, skip_special_tokens=False)
    out = bpe.encode_documents(docs, ids=True).collect()
    assert len(out) == docs.count() and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert bpe.encode_documents(none).count() == 0


def test_language(docs, none, spark):
    model = langid.train(spark.createDataFrame([(1, "the of and with this", "en"), (2, "der und nicht mit ein", "de"), (3, "это не так было", "ru"), (4, None, "en"), (5, "x", None)], "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en", "ru"]
    s = langid.Scorer(model, 2.0)
    path = s.paths(["the of with это было не und nicht der mit", "", "123 ²"])
    assert [model["langs"][k] for k in path[0]] == ["en"] * 3 + ["ru"] * 3 + ["de"] * 4
    assert len(path[1]) == len(path[2]) == 0
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (1, 2, 3)) and 0 < out[5]["score"] <= 1
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    scores = [r.normal(size=(n, 3)) * 3 for n in (1, 2, 255, 256, 257, 700, 0)]
    for s, path in zip(scores, langid.viterbi(scores, 4.0), strict=True):
        if not len(s):
            continue
        v = s[0]
        for t in range(1, len(s)):
            v = (v[:, None] - 4.0 * (1 - np.eye(3))).max(0) + s[t]
        assert np.isclose(s[np.arange(len(s)), path].sum() - 4.0 * np.count_nonzero(np.diff(path)), v.max())


def brute_lines(rows, least):
    """(doc_id, text left, lines, dropped) of each row."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({k: k + 32 for k in range(65, 91)})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize(("least", "batches"), [(10, None), (2, 1), (3, 7)])
def test_line_dedup(docs, none, spark, least, batches):
    r = random.Random(least)
    many = [(500 + k, "\n".join(r.choice(["A b", "a B ", "\tc", "", " ", "d\r", f"own {k}"]) for _ in range(r.randrange(1, 9)))) for k in range(60)]
    long = [(700, "\n".join(f"line {k % 40}" for k in range(30_000))), (701, "\n".join(f"LINE {k}" for k in range(0, 40, 2))), (702, "line 0\nline 2")]
    more = docs.unionByName(spark.createDataFrame(many + long, "doc_id long, text string"), allowMissingColumns=True)
    out = line_dedup.dedup_lines(more, min_docs=least, batches=batches)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"]
    got = sorted(((x["doc_id"], x["text"], x["n_lines_"], x["n_dropped"]) for x in out.collect()), key=repr)
    assert got == sorted(brute_lines([(x["doc_id"], x["text"]) for x in more.collect()], least), key=repr)
    # the caller's columns are as they were
    assert {x["n_lines"] for x in out.filter("doc_id < 100").collect()} == {1} and line_dedup.dedup_lines(docs, counts=None).columns == docs.columns
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_compact_and_sum(spark):
    runs = line_dedup.LineRuns(spark, min_docs=5, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (k, 2, 1)], "h1 long, h2 long, n_docs long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["h2"]): r["n_docs"] for r in spark.table(runs.levels[2][0]).collect()}[1, 1] == 4
    assert [tuple(r) for r in runs.close().collect()] == [(1, 1)]
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_frequent_key_is_not_added_again_and_runs_are_not_shuffled(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=9)
    for n in (2, 7):
        runs.add(spark.createDataFrame([(1, 1, n), (n, 2, 1)], "h1 long, h2 long, n_docs long"))
    assert sorted(tuple(r) for r in spark.table(runs.levels[0][1]).collect()) == [(7, 2, 1)]
    plan = line_dedup.merged(*map(spark.table, runs.levels[0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()


def brute_hits(text, items, n=13):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    ws, hit, found = split(text), set(), set()
    for item, t in items:
        q = split(t)
        k = min(n, len(q))
        for s in range(len(q) - k + 1) if q else []:
            for p in range(len(ws) - k + 1):
                if ws[p : p + k] == q[s : s + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_decontamination(docs, none, spark, bound):
    items = [(1, prose(3, 20)), (2, "Two"), (3, "漢字 😀"), (4, None), (5, "..."), (6, prose(3, 20)), (10, " ".join(prose(1, 30_000).split()[500:530]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(99, "x " + prose(3, 20).upper() + " y " + prose(3, 20))], "doc_id long, text string"), allowMissingColumns=True)
    short = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in more.collect()) if i not in (5, 6)]
    got = {}
    for r in decontaminate.contamination(more, bench, broadcast_bytes=bound).collect():
        got[r["doc_id"]] = (r["n_words"], r["n_hit"], r["items"])
    assert all(got[i] == brute_hits(t, items) for i, t in short)
    assert got[5][1:] == (30, ["10"])
    left = decontaminate.remove_contaminated(more.withColumns({"row": F.lit(1), "id": F.lit(2), "d": F.lit(3)}), bench).drop("row", "id", "d")
    assert left.columns == more.columns and 99 not in {r["doc_id"] for r in left.collect()} and 5 in {r["doc_id"] for r in left.collect()}
    assert decontaminate.contamination(none, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, bench.filter("false")).collect()} == {0}


def brute_components(rows):
    sets, root = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(docs, none, spark):
    rows, base = [], prose(77, 60).split()
    for k in range(60):  # a chain of edits: neighbours are alike, its ends are not
        base[(k * 7) % 60] = f"edit{k}"
        rows.append((1000 + k, " ".join(base)))
    rows += [(2000 + k, prose(5, 50)) for k in range(300)] + [(3000 + k, prose(5, 50) + f" tail{k}") for k in range(300)] + [(4000, "a b"), (4001, "A\tb"), (4002, "a b c d e"), (4003, "a b c d e")]
    more = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(more).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in more.collect()])
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == docs.count() and [r for r in out if r["doc_id"] is None][0]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(docs).columns == docs.columns


def test_a_cluster_of_many_short_texts_is_dealt_about_once(spark):
    """3,000 different texts of one template: their sets are under BLOCK_BYTES, but their pairs are 9 million."""
    rows = [(k, f"{prose(8, 30)} name{k}") for k in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    m = texts.select(F.lit(1).cast("long").alias("g"), F.col("doc_id").alias("id"), near_dedup.n_blocks(F.lit(3000), F.lit(27 * 8 * 3000)).alias("nb"))
    blocks = [r["count"] for r in near_dedup.one_block_each(m).groupBy("i").count().collect()]
    assert len(blocks) == 6 and max(blocks) <= 700 and 3000 < sum(blocks) < 3300
    out = near_dedup.near_duplicates(texts).collect()
    assert len(out) == 3000 and {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_links_between_blocks_of_texts_that_are_alike_but_not_linked(spark):
    """1,200 texts that share three fifths of their shingles: one cluster of three blocks, linked in pairs only."""
    own = lambda k: [f"own{k}x{j}" for j in range(12)]
    common = prose(9, 40)
    rows = [(k, f"{common} {' '.join(own(k % 600)[: 12 - k // 600])} {k // 600}") for k in range(1200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(texts).collect()}
    assert got == {k: k % 600 for k in range(1200)}


def test_open_groups_and_their_blocks(spark):
    """300 members outside of the largest component by all 1,200: every pair of them meets exactly once, all others of the largest never."""
    ids = spark.range(1200).select(F.lit(1).cast("long").alias("g"), "id", F.lit(3).alias("nb"))
    most = ids.filter("id < 900").select("id", F.lit(0).cast("long").alias("component"))
    groups = near_dedup.open_groups(ids, most)
    assert [tuple(r) for r in groups.collect()] == [(1, 0, 1)]
    assert near_dedup.open_groups(ids, ids.select("id", F.lit(0).alias("component"))) is None and near_dedup.open_groups(ids.withColumn("nb", F.lit(1)), most) is None
    rows = ids.join(groups.withColumn("nr", F.lit(2)), "g").withColumn("comp", F.when(F.col("id") < 900, 0).otherwise(F.col("id")))
    met = {}
    blocks = {}
    for r in near_dedup.across_blocks(rows).collect():
        blocks.setdefault((r["i"], r["j"]), ([], []))[r["side"]].append(r["id"])
    for left, right in blocks.values():
        pairs = [(a, b) for a in left for b in (right or left) if a != b]
        for a, b in pairs if right else [(a, b) for a, b in pairs if a < b]:
            key = (min(a, b), max(a, b))
            met[key] = met.get(key, 0) + 1
    assert set(met.values()) == {1} and set(met) == {(a, b) for a in range(1200) for b in range(max(a + 1, 900), 1200)}


def test_texts_of_one_id_are_one_node(spark):
    a, b = prose(21, 40), prose(22, 40)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, prose(23, 40)), (4, prose(23, 40)), (None, a), (5, None), (6, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"g": F.lit(1), "id": F.lit(2), "component": F.lit(3), "kept": F.lit(False)})
    out = near_dedup.near_duplicates(d).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True), (5, 5, True), (6, 6, True)} and len(out) == 9
    left = near_dedup.drop_near_duplicates(d)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {1, 4, 5, 6, None}


def test_estimates_are_in_memory_by_tiles():
    r, k = np.random.default_rng(1), 3000
    sets = [np.arange(16 * x, 16 * x + 16, dtype=np.uint64) for x in range(k)]
    m = {"id": np.arange(k), "n": np.full(k, 16), "comp": np.arange(k), "side": np.zeros(k, int), "bits": r.integers(0, 2**63, (k, 5), dtype=np.uint64), "set": sets}
    m["bits"][2000], sets[2000] = m["bits"][10], sets[10]
    tracemalloc.start()
    found = near_dedup.in_cluster(m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(10, 2000)] and peak < 150e6  # the whole square takes 360 MB a temporary


def test_components_of_a_path_and_a_star(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 700)] + [(900, 900)], "a long, b long")
    got = {r["id"]: r["component"] for r in near_dedup.components(links).collect()}
    assert {got[k] for k in range(101)} == {0} and {got[k] for k in range(500, 700)} == {500}


def brute_secrets(text):
    assign = re.compile(r"""(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secrets(docs, none, spark):
    r = random.Random(9)
    parts = ["password", 'API_Key"', "token = ", "secret:", "'", "=", "abcdef0123456789" * 2, "AKIAABCDEFGHIJKL99", "AKIA12", "short", "😀", "\n", " ", "longer-value.1", "deadbeef"]
    rows = [(5000 + k, "".join(r.choice(parts) for _ in range(12))) for k in range(300)] + [(999, "token=secret:abcdefgh AKIA😀 password: 'x1234567'"), (1000, "f" * 31 + " " + "f" * 32)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {k: t or "" for k, t in ((x["doc_id"], x["text"]) for x in d.collect())}
    ratios = secrets.train_markov(secrets.labelled_samples(d))
    for row in secrets.find_secrets(d, ratios).collect():
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"] if s["kind"] != "markov")
        assert base == brute_secrets(text[row["doc_id"]]), text[row["doc_id"]]
        assert all(text[row["doc_id"]][s["start"] : s["end"]] == s["text"] for s in row["spans"])
    assert secrets.find_secrets(none, ratios).count() == 0 and secrets.train_markov(secrets.labelled_samples(none)) == [0.0] * 128 * 128
    one = spark.createDataFrame([(1, "x password: hunter2hunter2 y")], "doc_id long, text string")
    out = secrets.find_secrets(one, ratios).join(one, "doc_id").select(secrets.redacted(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert out == "x [assign] y"


def test_markov_models_find_random_tokens(spark):
    r = random.Random(4)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    samples = [(draw(base64, 24), 1) for _ in range(2000)] + [(f"{r.choice(WORDS)}_{r.choice(WORDS)}_{r.randrange(3)}", 0) for _ in range(2000)]
    ratios = secrets.train_markov(spark.createDataFrame(samples, "token string, label int"))
    d = spark.createDataFrame([(1, f"see {draw(base64, 30)}1 and omicron_lambda_epsilon_2 here")], "doc_id long, text string")
    spans = secrets.find_secrets(d, ratios).first()["spans"]
    assert [s["kind"] for s in spans] == ["markov"] and spans[0]["start"] == 4 and spans[0]["llr"] > 0.5
    letters = "".join(x for x in draw(base64, 60) if x.isalpha())[:24]
    more = spark.createDataFrame([(1, f"{letters} and omicron-lambda-epsilon or 1234567890123456"), (2, "password: omicronlambda")], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(more, ratios).collect()}
    assert [(s["kind"], s["text"]) for s in out[1]] == [("markov", letters)] and [s["kind"] for s in out[2]] == ["assign"] and out[2][0]["llr"] < 0


def test_many_matches_in_one_text(spark):
    """More matches than one chunk of the fold has, and no work that grows with their square."""
    text = "\n".join(f"token={'ab12' * 3}{k} {'0123456789abcdef' * 2} AKIA{'A' * 12}" for k in range(4000))
    d = spark.createDataFrame([(1, text), (2, text[:5000])], "doc_id long, text string")
    for r in secrets.find_secrets(d, [0.0] * 128 * 128).collect():
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) == brute_secrets(text if r["doc_id"] == 1 else text[:5000])


def test_topk(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(400, 8)) * [9, 5, 3, 1, 1, 1, 1, 1], 2)
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(400 + k, [1.0] * 8) for k in range(20)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.scaled(F.col("embedding")).alias("v")).filter("v is not null")
    got = sorted(tuple(r) for r in topk.top_k(e, e.filter("vec_id % 50 = 0"), block=64, query_block=4).collect())
    v = np.floor(256 * np.array([b for _, b in rows[:420]]))
    want = []
    for q in range(0, 420, 50):
        s = v @ v[q]
        best = [j for j in np.lexsort((np.arange(420), -s)) if j != q][:5]
        want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    assert got == want
    assert topk.top_k(e.filter("false"), e.filter("false")).count() == 0
    assert topk.top_k(e.filter("vec_id < 2"), e.filter("vec_id = 0")).count() == 1


def test_topk_of_repeated_rows_ties_and_a_grid(spark):
    rows = [(0, [3.0, 1.0]), (0, [3.0, 1.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, 2.0]), (None, [9.0, 9.0]), (4, None)]
    e = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, v array<double>, rank string, score int")
    got = [tuple(r) for r in topk.top_k(e, e.filter("vec_id = 0")).collect()]
    # of the unlike rows of 50 the least vector counts
    assert sorted(got) == [(0, 1, 1, 8), (0, 2, 2, 4), (0, 3, 3, 4), (0, 4, 50, 1)]
    r = np.random.default_rng(7)
    x = r.integers(-9, 9, (500, 6)).astype(float)
    x[100:200] = x[100]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<double>")
    got = sorted(tuple(r) for r in topk.top_k(d, d.filter("vec_id % 5 = 0"), k=3, block=50, query_block=10, queries_held=3, tasks=4).collect())
    want = []
    for q in range(0, 500, 5):
        s = x @ x[q]
        want += [(q, n + 1, int(j), int(s[j])) for n, j in enumerate([j for j in np.lexsort((np.arange(500), -s)) if j != q][:3])]
    assert got == want
    # products beyond what doubles hold exactly
    big = spark.createDataFrame([(k, [float(2**30), float(k)]) for k in range(4)], "vec_id long, v array<double>")
    assert [tuple(r) for r in topk.top_k(big, big.filter("vec_id = 3"), k=2).orderBy("rank").collect()] == [(3, 1, 2, 2**60 + 6), (3, 2, 1, 2**60 + 3)]


def test_chat_round_trip_and_trees(spark):
    turns = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "\\<|x|>\\\\<\\|\n"), ("a\nb", ""), ("assistant", "😀")]
    text, mask = chat.format_turns(turns)
    assert chat.read_turns(text) == turns and [chat.unescape(text[a:b]) for a, b in mask] == [turns[1][1], "😀"]
    nodes = [(1, "r", None, 0.0), (1, "a", "r", 1.0), (1, "b", "r", 5.0), (1, "c", "a", 9.0), (1, "d", "b", 1.0), (2, "s", "gone", None)] + [(3, f"n{k}", f"n{k - 1}" if k else None, 0.0) for k in range(70)]
    tree = spark.createDataFrame(nodes, "tree long, node string, parent string, score double")
    got = {}
    for r in chat.choose_paths(tree, per_tree=2).collect():
        got.setdefault((r["tree"], r["path_rank"]), []).append((r["depth"], r["node"]))
    paths = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert paths == {(1, 1): ["r", "a", "c"], (1, 2): ["r", "b", "d"], (2, 1): ["s"], (3, 1): [f"n{k}" for k in range(70)]}
    rows = spark.createDataFrame([(5, 1, "assistant", None), (5, 0, None, "hi"), (5, 1, "assistant", "b"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    m = chat.as_trees(rows)
    out = {r["conv_id"]: r for r in chat.digests(chat.format_paths(chat.choose_paths(m), m)).collect()}
    assert out[5]["n_turns"] == 3 and out[5]["turns_sha256"] == hashlib.sha256(b"\nhi\nassistant\n\nassistant\nb\n").hexdigest() and out[5]["loss_chars"] == 1
    assert chat.choose_paths(tree.filter("false")).count() == 0


def test_chat_of_long_turns_empty_tables_and_other_columns(spark):
    long = "x\\<|im_end|>\n" * 100_000
    rows = [(1, 0, "user", long, "t", "n"), (1, 1, "assistant", long, "t", "n"), (None, 0, "assistant", "a", "t", "n"), (None, 0, "assistant", "a", "t", "n"), (3, None, "assistant", "", "t", "n")]
    c = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string, tree string, node string")
    m = chat.as_trees(c)
    out = {r["conv_id"]: r for r in chat.digests(chat.format_paths(chat.choose_paths(m), m)).collect()}
    assert out[1]["n_turns"] == 2 and out[1]["loss_chars"] == len(long) and out[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert (out[None]["n_turns"], out[None]["loss_chars"], out[3]["loss_chars"]) == (2, 2, 0)
    m = chat.as_trees(c.filter("false"))
    assert chat.digests(chat.format_paths(chat.choose_paths(m), m)).count() == 0


def test_quality(docs, none):
    labelled = docs.filter("doc_id is not null").withColumn("label", (F.col("doc_id") % 2).cast("int")).select("doc_id", "text", "label")
    rows = quality.score(docs, quality.train(labelled)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    empty = quality.train(labelled.filter("false"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5} and quality.score(none, empty).count() == 0


def test_dual_coordinate_descent_separates():
    xs = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, bias = quality.dual_coordinate_descent(xs, np.array([1.0, 1, -1, -1]), np.array([1.0, -1.0, 0.1, -0.1]), epochs=200)
    ratio = np.array([1.0, -1.0, 0.1, -0.1])
    assert [np.sign(w[x] @ ratio[x] + bias) for x in xs] == [1, 1, -1, -1]


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "http://EXAMPLE.org/en/12?x", "https://m.a.com/de/1", "http://com/fr/", "http://xcom/fr/", "a://b.org", "q?u=http://c.com/de/#f", "http://x.example.org/es/"]
    u = spark.createDataFrame([(k, g, "h") for k, g in enumerate(given)], "page_id long, url string, note string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(u, rules).collect()}
    assert out[0] == out[1] == out[2] == out[3] == ("", "", None, "allow")
    assert out[4] == ("example.org", "/en/12", "example.org/en/1", "block") and out[5][2:] == ("com/de/", "block") and out[6][2] == "com/fr/" and out[7][2] is None
    assert out[8] == ("b.org", "", None, "allow") and out[9] == ("c.com", "/de/", "com/de/", "block") and out[10][2:] == ("example.org/es/", "block")
    joined = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(u, rules, most_rules=0).collect()}
    assert joined == out
    assert urls.judge(u.filter("false"), rules).count() == 0 and urls.judge(u, rules.filter("false")).filter("rule is not null").count() == 0
    # the caller's columns are as they were
    own = u.withColumns({"Host": F.lit("h"), "rule": F.lit(7), "row": F.lit("r")})
    both = urls.judge(own, rules)
    assert both.columns == ["page_id", "url", "note", "Host", "rule", "row", "host_", "path", "rule_", "verdict"]
    assert {(r["Host"], r["rule"], r["row"]) for r in both.collect()} == {("h", 7, "r")}
    assert {r["page_id"]: (r["host_"], r["path"], r["rule_"], r["verdict"]) for r in both.collect()} == out
    twice = urls.judge(u.unionByName(u), rules)
    assert twice.count() == 2 * len(given) and {r["page_id"]: r["verdict"] for r in twice.collect()} == {k: v[3] for k, v in out.items()}


def test_digest_index_confirms_strings(tmp_path, monkeypatch):
    rules = [(f"h{k}", f"/{k}", "block" if k % 2 else "allow") for k in range(500)]
    (tmp_path / "a").write_bytes(urls.DigestIndex.packed(rules))
    index = urls.DigestIndex(str(tmp_path / "a"))
    found = index.probe([f"h{k}/{k}" for k in range(500)] + ["h7/8", ""])
    assert [index.names[index.verdict[k]] for k in found[:500]] == [v for _, _, v in rules] and found[500:].tolist() == [-1, -1]
    (tmp_path / "b").write_bytes(urls.DigestIndex.packed([]))
    assert urls.DigestIndex(str(tmp_path / "b")).probe(["h7/7"]).tolist() == [-1]
    # all digests equal: the strings tell
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: 1)
    (tmp_path / "c").write_bytes(urls.DigestIndex.packed(rules))
    index = urls.DigestIndex(str(tmp_path / "c"))
    assert [index.string(k) for k in index.probe(["h7/7", "h9/9"])] == ["h7/7", "h9/9"] and index.probe(["h7/8"]).tolist() == [-1]
