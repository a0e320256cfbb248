"""The registered queries against DuckDB and brute force, on the smallest tables."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.dirname(__file__)), os.path.dirname(__file__)]
from conftest import rows_of  # noqa: E402
from test_llm_edges import brute_components, brute_lines, brute_secrets  # noqa: E402

from storegrain.llm import langid, quality, secrets  # noqa: E402
from storegrain.llm import queries as Q  # noqa: E402
from storegrain.llm.bpe import vocabulary_path  # noqa: E402
from storegrain.llm.common import bounded_share, landed  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert rows_of(Q.QUERIES[name](spark, sf_dir).toPandas()) == duck(Q.SQL[name])


def test_bpe_same_as_the_library(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    from storegrain.llm.bpe import vocabulary_path

    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.QUERIES["op1_bpe_encoding"](spark, sf_dir).collect():
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


def out_of_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_as_by_one_pass_over_each_text(spark, sf_dir):
    """Counts word by word, and the plain recursion over the words of a text."""
    docs = documents(spark, sf_dir)
    known = [(t, x) for i, t, x in docs if t is not None and x is not None and not out_of_training(i)]
    langs = sorted({x for _, x in known})
    n = np.zeros((langid.BUCKETS + len(langid.NAMES), len(langs)))
    scored = {}

    def cells(word):
        if word not in scored:
            scored[word] = np.bincount(langid.grams([word])[0], minlength=langid.BUCKETS).nonzero()[0], langid.grams([word])[0]
        return scored[word][1]

    letters = lambda t: [w for w in langid.WORD.findall(t or "") if langid.first_letter(w)]
    for t, x in known:
        k = langs.index(x)
        for w in letters(t):
            np.add.at(n[:, k], cells(w), 1)
            n[langid.BUCKETS + langid.script_of(langid.first_letter(w)), k] += 1
    g, scripts = n[: langid.BUCKETS] + 0.1, n[langid.BUCKETS :]
    logp, seen = np.log(g / g.sum(0)), scripts > 0.001 * np.maximum(scripts.sum(0), 1)

    def score(w):
        c = cells(w)
        s = logp[c].sum(0) * min(len(c), 8) / len(c)
        allowed = seen[langid.script_of(langid.first_letter(w))]
        return np.where(allowed, s, s.min() - 20) if allowed.any() else s

    want = {}
    for i, t, _ in docs:
        s = np.array([score(w) for w in letters(t)])
        if not len(s):
            want[i] = ("und", 0.0)
            continue
        v, back = s[0], []
        for row in s[1:]:
            jump = v.max() - 6.0
            back.append(np.where(v >= jump, np.arange(len(langs)), v.argmax()))
            v = np.maximum(v, jump) + row
        at = [int(v.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        share = np.bincount(at, minlength=len(langs)) / len(at)
        want[i] = (langs[int(share.argmax())], round(float(share.max()), 9))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in Q.QUERIES["op2_language_id"](spark, sf_dir).collect()}
    assert got == want


def test_language_of_held_out_documents(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in Q.QUERIES["op2_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert held and all(r["held_out"] == out_of_training(r["doc_id"]) for r in held) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_quality_as_fitted_in_one_place(spark, sf_dir):
    """The class counts, the model and the scores from plain loops over all documents."""
    docs = documents(spark, sf_dir)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None}
    sets = {i: quality.indicators(t, quality.Tokens()) for i, t, _ in docs}
    known = sorted(i for i in sets if i in labels and not out_of_training(i))
    n, totals = np.full((2, quality.BUCKETS), 1.0), [0, 0]
    for i in known:
        n[labels[i]][sets[i]] += 1
        totals[labels[i]] += 1
    ratio = np.log((n[1] / (totals[1] + 2)) / (n[0] / (totals[0] + 2)))
    w, bias = quality.dual_coordinate_descent([sets[i] for i in known], np.array([1.0 if labels[i] else -1.0 for i in known]), ratio)
    margin = lambda i: float((w * ratio)[sets[i]].sum() + bias)
    scale = 2.0 / np.mean([abs(margin(i)) for i in known])
    got = {r["doc_id"]: r["score"] for r in Q.QUERIES["op6_quality_classifier"](spark, sf_dir).collect()}
    assert got.keys() == sets.keys()
    for i in sets:
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(margin(i) * scale, -30, 30)))) < 1e-9


def test_quality_of_held_out_documents(spark, sf_dir):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = Q.QUERIES["op6_quality_classifier"](spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("total", [0, 10, 4_000, 10**11, 10**14])
def test_samples_stay_as_large_at_any_total(total):
    most, bound = bounded_share(4_000, total), 4_000
    share = (most + 2**63) / 2**64
    assert share == 1 - 2**-64 if total <= bound else abs(share * total - bound) < 0.01


def test_near_dedup_as_by_all_pairs(spark, sf_dir):
    want = brute_components([(i, t) for i, t, _ in documents(spark, sf_dir)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in Q.QUERIES["op9_minhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_secrets_as_by_plain_loops(spark, sf_dir):
    """Base spans by one pass of each pattern, the models from pair counts, the tokens judged one by one."""
    docs = [(i, t or "") for i, t, _ in documents(spark, sf_dir)]
    value = re.compile("[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$")
    base = {i: [(k.split(":")[0], int(k.split(":")[1]), int(k.split(":")[2])) for k in brute_secrets(t).split(",") if k] for i, t in docs}
    own = lambda t, s: value.search(t[s[1] : s[2]])[1] if s[0] == "assign" else t[s[1] : s[2]]
    plain = "(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{8,}"
    samples = [(label, token, out_of_training(i)) for i, t in docs for label, token in [(1, own(t, s)) for s in base[i]] or [(0, x) for x in re.findall(plain, t)]]

    def ratios(chosen):
        n = np.zeros((2, 128, 128))
        for label, token in chosen:
            for a, b in zip(token, token[1:], strict=False):
                n[label, ord(a), ord(b)] += 1
        rows = n.sum(2, keepdims=True)
        w = np.minimum(rows, secrets.EVIDENCE)
        p = np.log((n * w / np.maximum(1, rows) + 0.5) / (w + 48))
        return np.where(n.sum(0) > 0, p[1] - p[0], 0.0)

    score = lambda r, x: float(np.mean([r[ord(a), ord(b)] for a, b in zip(x, x[1:], strict=False)]))
    r = ratios([s[:2] for s in samples if not s[2]])
    judged = [sorted(score(r, x) for x in {t for y, t, out in samples if out and y == label and len(t) >= least}) for label, least in ((1, 2), (0, 16))]
    low, high = (xs[int(np.ceil(q * len(xs))) - 1] if xs else None for xs, q in zip(judged, secrets.QUANTILES, strict=True))
    threshold = 0.75 * low + 0.25 * high if low is not None and high is not None and low > high else 0.5
    r = ratios([s[:2] for s in samples])
    mean = lambda x: score(r, x)
    got = {r["doc_id"]: r for r in Q.QUERIES["op10_secret_scans"](spark, sf_dir).collect()}
    for i, t in docs:
        found = [(s, mean(own(t, s))) for s in base[i]]
        for m in re.finditer("(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}", t):
            if not any(s[1] < m.end() and m.start() < s[2] for s in base[i]) and mean(m[0]) > threshold:
                found.append((("markov", m.start(), m.end()), mean(m[0])))
        kinds = ["assign", "access", "hex", "markov"]
        found.sort(key=lambda x: (x[0][1], kinds.index(x[0][0])))
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for (k, a, b), _ in found)
        assert [float(x) for x in got[i]["llrs"].split()] == pytest.approx([x for _, x in found], abs=6e-4)
        only = ",".join(f"{k}:{a}:{b}" for k, a, b in base[i])
        assert got[i]["base_sha256"] == hashlib.sha256(only.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds[:3]] == [sum(s[0] == k for s in base[i]) for k in kinds[:3]]


def test_markov_models_alone_on_held_out_documents(spark, sf_dir):
    r = secrets.held_out_accuracy(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")).first()
    assert r["tp"] >= 5 and r["tp"] >= 0.95 * (r["tp"] + r["fp"]) and r["tp"] >= 0.95 * (r["tp"] + r["fn"]) and r["tn"] > 20


def test_pipeline_stages_as_by_plain_loops(spark, sf_dir):
    """What each stage keeps of its own input, and the texts that it leaves."""
    import corpus_pipeline as P

    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    before = texts(docs)
    stage = dict(P.STAGES)

    docs = landed(stage["language_id"](spark, docs, sf_dir), "test")
    want = {i: t for i, t in before.items() if any(x.isalpha() for x in t or "")}
    assert docs.columns == columns and texts(docs) == want

    docs = landed(stage["line_dedup"](spark, docs, sf_dir), "test")
    want = {i: t for i, t, _, _ in brute_lines(list(want.items()), 10)}
    assert docs.columns == columns and texts(docs) == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = landed(stage["near_dedup"](spark, docs, sf_dir), "test")
    of = brute_components(list(want.items()))
    want = {i: t for i, t in want.items() if of[i][1] == i}
    assert docs.columns == columns and texts(docs) == want

    docs = landed(stage["decontamination"](spark, docs, sf_dir), "test")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = contaminated_ids(want, items)
    want = {i: t for i, t in want.items() if i not in bad}
    assert docs.columns == columns and texts(docs) == want and bad

    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    for r in stage["bpe_encoding"](spark, docs, sf_dir).collect():
        ids = t.encode(want.pop(r["doc_id"]), add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not want


def contaminated_ids(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = {}
    for _, t in items:
        q = split(t)
        k = min(13, len(q))
        for s in range(len(q) - k + 1 if q else 0):
            windows.setdefault(k, set()).add(tuple(q[s : s + k]))
    out = set()
    for i, t in docs.items():
        ws, hit = split(t), set()
        for k, grams in windows.items():
            for p in range(len(ws) - k + 1):
                if tuple(ws[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
        if hit and 20 * len(hit) >= len(ws):
            out.add(i)
    return out


def test_pipeline_stages_on_edges(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, more columns, and no rows at all."""
    import corpus_pipeline as P

    long = " ".join(f"word{k % 977} of" for k in range(150_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here at all", None, None, None), (3, long, "en", "s", 9), (3, long, "en", "s", 9), (4, "a b\nc", "de", "s", 3), (5, "12 34", "en", "s", 5)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"row": F.lit(1), "id": F.lit(2), "d": F.lit(3), "n_lines": F.lit(4), "n_dropped": F.lit(5), "score": F.lit(6), "spans": F.lit("x"), "lang_pred": F.lit("y"), "kept": F.lit(True), "g": F.lit(7)}
    for name, stage in P.STAGES:
        for docs in (base, base.withColumns(extra)):
            out = landed(stage(spark, docs, sf_dir), "edges")
            n = [r["doc_id"] for r in out.collect()]
            assert out.columns == docs.columns or name == "bpe_encoding"
            if "d" in docs.columns and name != "bpe_encoding":
                assert {tuple(r[c] for c in extra) for r in out.collect()} == {(1, 2, 3, 4, 5, 6, "x", "y", True, 7)}
            assert sorted(map(str, n)) == {"language_id": ["3", "3", "4", "None"]}.get(name, ["1", "2", "3", "3", "4", "5", "None"]), name
            assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_a_broken_subpackage_is_not_hidden():
    import __spark_entry__ as entry

    assert entry.llm_queries is Q and set(Q.QUERIES) <= set(entry.queries())
