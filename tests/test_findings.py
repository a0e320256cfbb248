"""Findings, history, crawl plans and passages on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from storegrain.operators import crawl as W
from storegrain.operators import findings as N
from storegrain.operators import history as H
from storegrain.operators import retrieval as V

FIND = "store_id string, run_id string, seq long, check_id string, title string, severity string, confidence string, page_url string, evidence string, location string"


def findings(spark, *rows):
    """rows: check_id, page_url, location."""
    return spark.createDataFrame([("s", "r", k, c, f"title of {c}", "low", "confirmed", page, f"seen {k}", where) for k, (c, page, where) in enumerate(rows)], FIND)


def rolled(spark, rows):
    return sorted(((r["check_id"], r["n"], r["n_pages"], r["page_url"], r["evidence"], r["location"]) for r in N.rolled_up(findings(spark, *rows)).collect()), key=repr)


def test_roll_up(spark):
    link = lambda u: f'a[href="{u}"]'
    one = rolled(spark, [("https_mixed_content_link", f"p{k}", link("http://a/x")) for k in range(5)])
    assert one == [("https_mixed_content_link", 5, 5, None, "Link to http://a/x found on 5 page(s): p0, p1, p2, p3, p4", 'a[href="http://a/x"]')]
    assert len(rolled(spark, [("https_mixed_content_link", f"p{k}", link(f"http://a/{k % 2}")) for k in range(8)])) == 2
    many = rolled(spark, [("external_domain_link", f"p{k % 11}", link(f"https://www.d{k // 11}.example/{k}")) for k in range(33)])
    assert [(r[1], r[2], r[5]) for r in many] == [(11, 11, f'a[href*="www.d{k}.example"]') for k in range(3)] and many[0][4].endswith("page(s): p0, p1, p2, p3, p4, and 6 more")
    images = rolled(spark, [("product_image_broken", f"p{k}", f'img[src="/{k}.png"]') for k in range(2)] + [("product_image_broken", None, None)])
    assert images == [("product_image_broken", 3, 2, None, "title of product_image_broken - 3 instance(s) across 2 page(s), including: /0.png (on p0), /1.png (on p1), ? (on unknown page)", N.SITE_WIDE)]


def test_what_is_not_rolled_up(spark):
    # checks without a strategy, checks and values of fewer than three findings, and findings without a link
    rows = [("required_page_present", None, "site-wide")] * 4 + [("broken_image", "p", 'img[src="/x"]')] * 2 + [("external_domain_link", "p", None)] * 3 + [("https_mixed_content_link", f"p{k}", f'a[href="http://a/{k}"]') for k in range(3)]
    out = rolled(spark, rows)
    assert len(out) == len(rows) and {r[1] for r in out} == {1} and {r[4] for r in out} == {f"seen {k}" for k in range(len(rows))}


def test_impact(spark):
    f = spark.createDataFrame([("required_page_present", "Missing required page: Privacy policy"), ("required_page_present", "Missing required page: Contact info"), ("llm_policy_substance_returns_refunds", ""), ("llm_editorial_quality", ""), ("broken_image", ""), ("never heard of", "")], "check_id string, title string")
    got = [tuple(r)[2:] for r in N.with_impact(f).collect()]
    general, editorial = "support.google.com/merchants/answer/13693195", "support.google.com/merchants/answer/12079604"
    assert got[:2] == [("suspension_risk", general, "privacy_policy", "ads_and_listings"), ("suspension_risk", general, "business_identity", "ads_and_listings")]
    assert got[2:4] == [("suspension_risk", general, "returns_refunds", "ads_and_listings"), ("quality_improvement", editorial, "editorial_quality", "ads_and_listings")]
    assert got[4:] == [("listing_disapproval", None, None, "unclear")] * 2


def test_page_status_and_catalog(spark):
    key = "store_id string, run_id string, "
    pages = spark.createDataFrame([("s", "r", u, k, True, False, "product") for k, u in enumerate(["https://a/x/page/2", "https://a/x", "https://a/y", "https://a/z", "https://a/w"])] + [("s", "r", "gone", 7, False, False, "faq"), ("s", "r", "blocked", 8, False, True, "faq")], key + "url string, seq long, reachable boolean, cannot_verify boolean, page_type string")
    rows = [("https://a/x/page/2", "low", "suspension_risk", "confirmed"), ("https://a/y", "low", "x", "cannot_verify"), ("https://a/z", "low", "x", "confirmed"), ("https://a/z", "high", "x", "cannot_verify")]
    f = spark.createDataFrame([("s", "r", *r, "page_only") for r in rows], key + "page_url string, severity string, impact_tier string, confidence string, verification_method string")
    got = {r["url"]: r["status"] for r in N.page_status(pages, f).collect()}
    assert got == {"https://a/x/page/2": "RISK", "https://a/x": "PASS", "https://a/y": "CANNOT VERIFY", "https://a/z": "RISK", "https://a/w": "PASS", "gone": "UNREACHABLE", "blocked": "CANNOT VERIFY"}
    c = N.catalog_rollup(pages, f)
    assert {r["page_group"]: (r["variants"], r["representative"], r["state"]) for r in c.collect()} == {"https://a/x": (2, "https://a/x", "flagged"), "https://a/y": (1, "https://a/y", "other"), "https://a/z": (1, "https://a/z", "other"), "https://a/w": (1, "https://a/w", "clean")}
    assert tuple(N.catalog_counts(c).first())[2:] == (4, 5, 1, 2, 1, 3)
    runs = spark.createDataFrame([("s", "r", "woocommerce"), ("t", "r", "shopify")], key + "platform string")
    assert {r["store_id"]: r["recommended"] for r in N.needs_api(runs, f).collect()} == {"s": True, "t": False}
    assert N.export_rows(f).columns == N.EXPORT and N.export_rows(f).filter("page_url = 'https://a/y' and title = '' and verification_method = 'page_only'").count() == 1


def test_delta(spark):
    f = lambda *rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq int, key string, evidence string, severity string")
    old = f(("gone", "e", "low"), ("ev", "e", "low"), ("sev", "e", "low"), ("same", "x", "low"), ("same", "e", "low"))
    new = f(("new", "e", "low"), ("ev", "f", "low"), ("sev", "e", "high"), ("same", "e", "low"))
    assert {r["key"]: r["change"] for r in N.delta(old, new, ["key"]).collect()} == {"gone": "resolved", "new": "new", "ev": "changed", "sev": "changed", "same": "unchanged"}


def test_score_rounds_half_to_even(spark):
    rows = [("s", "r", k, "low", "quality_improvement", "confirmed") for k in range(3)] + [("t", "r", 9, "critical", "x", "confirmed"), ("t", "r", 10, "critical", "x", "cannot_verify")]
    f = spark.createDataFrame(rows, "store_id string, run_id string, seq int, severity string, impact_tier string, confidence string")
    runs = spark.createDataFrame([("s", "r", False), ("t", "r", False), ("u", "r", True)], "store_id string, run_id string, failed boolean")
    assert {r["store_id"]: (r["score"], r["rating"]) for r in N.risk_score(runs, f).collect()} == {"s": (98, "LOW"), "t": (75, "HIGH"), "u": (None, "N/A")}
    rows = [("v", "r", k, "high", "suspension_risk", "confirmed") for k in range(9)] + [("v", "r", 20, "critical", "listing_disapproval", "confirmed"), ("v", "r", 21, "low", "listing_disapproval", "potential_risk"), ("w", "r", 1, "low", "x", "cannot_verify")] + [("v", "r", 30 + k, "low", "quality_improvement", "confirmed") for k in range(3)]
    f, runs = f.union(spark.createDataFrame(rows, f.schema)), runs.union(spark.createDataFrame([(x, "r", False) for x in "vwx"], runs.schema))
    got = {r["store_id"]: (r["score"], r["breakdown"]) for r in N.risk_score(runs, f).collect()}
    left_out = "1 finding(s) excluded from scoring: cannot-verify (an unconfirmed issue doesn't move this score either way)."
    assert got["s"] == (98, ["-1.5: 3 quality-improvement finding(s) (0.5 pt each)"])
    assert got["t"] == (75, ["-25: 1 suspension-risk finding(s) at critical severity (25 pt each)", left_out])
    assert got["v"] == (0, ["-25: 1 suspension-risk finding(s) at critical severity (25 pt each)", "-135: 9 suspension-risk finding(s) at high severity (15 pt each)", "-1: 1 listing-disapproval finding(s) at low severity (1 pt each)", "-1.5: 3 quality-improvement finding(s) (0.5 pt each)", "Raw score before clamping: -62 - floored to 0 (score is always shown in the 0-100 range)."])
    none = "No confirmed findings to deduct for - starting score of 100 stands."
    assert got["w"] == (100, [none, left_out]) and got["x"] == (100, [none]) and got["u"][1] == [N.NO_SCORE]


def test_citations(spark):
    pages = spark.createDataFrame([("s", "r", u) for u in ("https://a/1", "https://a/2", "https://a/3")], "store_id string, run_id string, url string")
    ev = spark.createDataFrame([("s", "r", "x", "https://a/1", None, "see https://a/2), and https://gone/9.")], "store_id string, run_id string, rule_id string, resource_url string, observed array<string>, text string")
    cited = N.cited_pages(ev, pages)
    assert {r["url"] for r in cited.collect()} == {"https://a/1", "https://a/2"} and N.kept_bodies(pages, cited).count() == 2 and N.kept_bodies(pages, cited, True).count() == 3


def test_reconciled_and_verdicts(spark):
    key = "store_id string, run_id string, url string"
    pages = spark.createDataFrame([("s", "r", "u", "Returns within 30 days &amp; more")], key + ", text string")
    regex = spark.createDataFrame([("s", "r", "u", f, v, 0.8) for f, v in (("return.window_days", "30"), ("b", "30"), ("c", "30"), ("d", "30"), ("e", "30"))], key + ", fact string, value string, confidence double")
    regex = regex.union(spark.createDataFrame([("s", "r", "u", "f", "30", 0.8)], regex.schema))
    model = spark.createDataFrame([("s", "r", "u", "return.window_days", "30.0", "within 30 days", 0.7), ("s", "r", "u", "b", None, None, None), ("s", "r", "u", "c", "14", "30 DAYS & more", 0.97), ("s", "r", "u", "d", "14", "not there", 0.9), ("s", "r", "u", "f", "9", " ", 1.7), ("s", "r", "u", "g", "9", None, -1.0)], key + ", fact string, value string, quote string, confidence double")
    got = {r["fact"]: (r["value"], r["method"], r["confidence"]) for r in N.reconciled(regex, model, pages).collect()}
    assert got == {"return.window_days": ("30.0", "regex_llm_agree", 0.95), "c": ("14", "llm", 0.97), "e": ("30", "regex", 0.8), "f": ("9", "llm", 1.0), "g": ("9", "llm", 0.0)}
    v = spark.createDataFrame(
        [("s", "r", "u", "x", True, "high", "30 days", None, None), ("s", "r", "u", "y", True, "high", "no such", None, None), ("s", "r", "u", "llm_claim_policy_contradiction", True, "high", "30 days", "our 30 days", "days"), ("s", "r", "u", "z", False, "high", "30 days", None, None)],
        key + ", check_id string, flagged boolean, confidence string, evidence_quote string, policy_quote string, conflict_dimension string",
    )
    assert {r["check_id"]: (r["confidence"], r["evidence_verified"]) for r in N.verdict_findings(v, pages).collect()} == {"x": ("high", True), "y": ("high", False)}
    said = lambda confidence, quote: N.verdict_findings(v.filter("check_id = 'x'").withColumns({"confidence": F.lit(confidence), "evidence_quote": F.lit(quote).cast("string")}), pages).first()["confidence"]
    assert [said(c, q) for c in ("confirmed", "potential_risk", "cannot_verify") for q in ("no such", "30  Days", None, "")] == ["potential_risk", *["confirmed"] * 3, *["potential_risk"] * 4, *["cannot_verify"] * 4]
    i = spark.createDataFrame([("s", "r", "u", "i1"), ("s", "r", "w", "i1"), ("s", "r", "u", "i2")], key + ", image_url string")
    iv = spark.createDataFrame([("i1", False, True)], "image_url string, plausible_match boolean, potentially_prohibited boolean")
    assert sorted((r["url"], r["check_id"]) for r in N.image_findings(i, iv).collect()) == [("u", "llm_image_product_mismatch"), ("u", "llm_image_prohibited_content_flag"), ("u", "llm_image_vision_check"), ("w", "llm_image_product_mismatch"), ("w", "llm_image_prohibited_content_flag")]
    assert N.union_all(i, iv).count() == 4


def test_history(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    runs = spark.createDataFrame([("s", k, day(k)) for k in range(1, 6)], "store string, run_id int, started_at timestamp")
    assert {r["run_id"] for r in H.to_prune(runs, ["store"], 2).collect()} == {1, 2, 3}
    now = F.lit("2024-01-05").cast("date")
    assert {r["run_id"] for r in H.expired(runs, ["store"], now, days=3, keep=1).collect()} == {1}
    assert H.expired(runs, ["store"], now).count() == 0
    timed = spark.createDataFrame([("s", 1, day(1), None), ("s", 2, day(1), dt.datetime(2024, 1, 2, 1, 30)), ("s", 3, day(2), dt.datetime(2024, 1, 2, 1, 29, 59)), ("s", 4, day(9), None)], "store string, run_id int, started_at timestamp, finished_at timestamp")
    assert {r["run_id"] for r in H.expired(timed, ["store"], F.lit(dt.datetime(2024, 1, 5, 1, 30)), days=3).collect()} == {1, 3}
    old = spark.createDataFrame([("s", "a", "1", day(1)), ("s", "b", "1", day(1))], "store string, url string, h string, fetched_at timestamp")
    new = spark.createDataFrame([("s", "a", "2", day(2)), ("s", "c", "1", day(2))], old.schema)
    assert {r["url"]: r["h"] for r in H.upsert_snapshots(old, new, ["store", "url"]).collect()} == {"a": "2", "b": "1", "c": "1"}
    assert {r["url"] for r in H.changed(new, old, ["store", "url"], ["h"]).collect()} == {"a", "c"}
    assert {r["url"] for r in H.changed(new, old, ["store", "url"], ["h"], first_sight=False).collect()} == {"a"}
    stores = spark.createDataFrame(
        [("a", "interval", 3, None, day(1), None, True), ("b", "interval", 30, None, day(1), None, False), ("c", "on_change", None, 2, None, day(2), True), ("d", "both", 3, 30, None, day(4), True), ("e", "on_change", None, 9, None, day(2), False), ("f", "weekly", 1, 1, None, None, False), ("f", "both", 0, None, None, None, False)],
        "url string, mode string, interval_days int, cheap_check_interval_days int, last_full_audit_at timestamp, last_cheap_check_at timestamp, on_policy_change boolean",
    )
    assert {(r["url"], r["full"], r["cheap"]) for r in H.due(stores.filter("url <> 'f'"), now).collect()} == {("a", True, False), ("c", False, True), ("d", True, False)}
    assert sorted(tuple(r) for r in H.registration_errors(stores).collect()) == [("f", "already registered"), ("f", "cheap_check_interval_days is required"), ("f", "interval_days is required"), ("f", "unknown mode")]
    jobs = spark.createDataFrame([(1, day(1)), (2, day(3)), (3, day(2))], "job_id int, created_at timestamp")
    assert {r["job_id"] for r in H.old_jobs(jobs, now, 3).collect()} == {1}
    assert {r["job_id"] for r in H.old_jobs(jobs, F.lit(dt.datetime(2024, 1, 5, 22, 30)), 3).collect()} == {1, 3}
    stored = spark.createDataFrame([("a", 5, 2, day(1)), ("b", 5, 1, day(1)), ("e", 1, 3, day(1))], "hash string, bytes int, refcount int, last_referenced_at timestamp")
    moves = [("a", 1, 2), ("a", -1, 2), ("b", -1, 2), ("b", -1, 2), ("b", -1, 3), ("b", 1, 3), ("b", 1, 4), ("b", -1, 4), ("c", -1, 2), ("d", 1, 2), ("d", -1, 3), ("d", -1, 3)]
    deltas = spark.createDataFrame([(h, 5, c, day(d), k) for k, (h, c, d) in enumerate(moves)], "hash string, bytes int, change int, at timestamp, seq int")
    got = {r["hash"]: (r["refcount"], r["released"]) for r in H.merged_blobs(stored, deltas).collect()}
    assert got == {"a": (2, False), "b": (1, False), "c": (0, True), "d": (0, True), "e": (3, False)}
    objects = spark.createDataFrame([("a",), ("d",), ("zz",)], "hash string")
    assert {r["hash"] for r in H.orphans(objects, H.merged_blobs(stored, deltas)).collect()} == {"d", "zz"}
    changed = spark.createDataFrame([("p2",), ("p1",)], "policy_id string")
    assert {(r["url"], r["trigger"]) for r in H.reaudits(changed, stores).collect()} == {(u, "p1, p2") for u in "acd"} and H.reaudits(changed.limit(0), stores).count() == 0
    texts = spark.createDataFrame([("p", 1, "a  b"), ("p", 2, "c")], "policy_id string, pos int, text string")
    h = lambda df: H.policy_hashes(df).first()["hash"]
    assert h(texts) == h(texts.withColumn("text", F.regexp_replace("text", " +", " "))) != h(texts.withColumn("pos", 3 - F.col("pos")))
    refs = spark.createDataFrame([("x", day(1)), ("x", day(3)), ("y", day(2))], "content string, at timestamp")
    assert sorted(r["refcount"] for r in H.blobs(refs).collect()) == [1, 2]


def test_crawl(spark):
    pages = spark.createDataFrame([("s", "r", 0, ["a", "b", "c"]), ("s", "r", 1, ["d", "a"]), ("s", "r", 2, []), ("t", "r", 0, ["a"])], "store_id string, run_id string, seq int, links array<string>")
    got = sorted((r["store_id"], r["child"], r["parent"], r["url"]) for r in W.interleaved(pages).collect())
    assert [(r[0], r[3]) for r in got] == [("s", "a"), ("s", "d"), ("s", "b"), ("s", "c"), ("t", "a")]
    key = "store_id string, run_id string, "
    rows = [("h", 0, 0)] + [(f"o{k:02}", 1, k) for k in range(30)] + [(f"c{k:02}", 2, k) for k in range(30)]
    urls = spark.createDataFrame([(s, "r", *r) for s in "st" for r in rows] + [("t", "r", f"x{k}", 3, k) for k in range(2000)], key + "url string, tier int, pos int")
    budgets = spark.createDataFrame([("s", "r", 30), ("t", "r", 9000)], key + "budget int")
    plan = W.plan(urls, budgets).orderBy("tier", "pos", "url").collect()
    assert [r["url"] for r in plan if r["store_id"] == "s"] == ["h"] + [f"o{k:02}" for k in range(10)] + [f"c{k:02}" for k in range(19)]
    assert len([r for r in plan if r["store_id"] == "t"]) == 500
    b = spark.createDataFrame([(0, 0), (0, 10), (0, 99), (5, 99), (100, 1)], "c int, l int").select(W.page_budget(F.col("c"), F.col("l")).alias("b"))
    assert [r["b"] for r in b.collect()] == [60, 60, 99, 60, 240]
    u = spark.createDataFrame([("https://s/product-category/mugs/blue/", "https://s/c", "collection"), ("https://s/product-category/mugs/blue/", "https://s/", "homepage"), ("https://s/mug", None, None)], "u string, f string, k string")
    assert [r["c"] for r in u.select(W.category(F.col("u"), F.col("f"), F.col("k")).alias("c")).collect()] == ["https://s/c", "/product-category/mugs", "/"]
    images = [("s", "r", p, f"u{p}", k, f"i{p}-{k}" if p != 3 else "i1-0", "product") for p in range(8) for k in (1, 0)] + [("s", "r", -1, "home", 0, "h", "homepage"), ("t", "r", 0, "v", 5, "j", "product")]
    shown, work = W.image_work(spark.createDataFrame(images, key + "seq int, url string, pos int, image_url string, page_type string"))
    assert {(r["url"], r["image_url"]) for r in shown.collect()} == {("u0", "i0-0"), ("u1", "i1-0"), ("u2", "i2-0"), ("u3", "i1-0"), ("u4", "i4-0"), ("v", "j")} and work.count() == 5
    p = spark.createDataFrame([("s", "r"), ("s", "r"), ("t", "r")], "store_id string, run_id string")
    assert {r["store_id"]: (r["coverage"], r["is_partial"]) for r in W.sample_coverage(p, p.limit(1)).collect()} == {"s": (0.5, True), "t": (0.0, True)}


def test_passages(spark):
    chunks = spark.createDataFrame([("p", "u", "one", 0, [1.0, 0.0]), ("p", "u", "two", 0, [0.0, 1.0]), ("p", "u", "two", 1, [0.1, 1.0]), ("q", "u", "x", 0, [0.0, 1.0])], "policy_id string, source_url string, section string, chunk_index int, vector array<double>")
    queries = spark.createDataFrame([(1, "p", [0.0, 1.0]), (2, "p", [0.0, 0.0])], "query_id int, policy_id string, vector array<double>")
    got = [(r["query_id"], r["section"], round(r["score"], 3)) for r in V.best_passages(queries, chunks, 1).orderBy("query_id").collect()]
    assert got == [(1, "two", 1.0), (2, "one", 0.0)]
    dated = chunks.withColumns({"created_at": F.to_timestamp(F.concat(F.lit("2024-01-0"), F.length("section"))), "chunk_text": F.concat_ws(" ", "section", "chunk_index")})
    best = V.best_passages(queries.filter("query_id = 1"), dated, 2)
    assert tuple(V.context(best, dated).first()) == (1, "two 0\n\none 0", dt.datetime(2024, 1, 3))
    text = " ".join(f"Sentence number {k} says something of note." for k in range(80))
    c = V.packed(spark.createDataFrame([(1, text), (2, "short"), (3, "x" * 1500)], "id int, text string")).orderBy("id", "chunk_index").collect()
    assert " ".join(r["chunk_text"] for r in c if r["id"] == 1) == text and all(len(r["chunk_text"]) <= 1200 for r in c if r["id"] == 1) and {r["id"] for r in c} == {1, 3}
    old, new = chunks.filter("policy_id = 'p'"), chunks.filter("policy_id = 'q'")
    assert V.rebuilt(old, new).count() == 4 and V.rebuilt(old, old.limit(1)).count() == 1


def test_passages_by_blocks_are_those_of_every_pair(spark, monkeypatch):
    """Small blocks, two policies, equal and scaled vectors, vectors without length, with nulls, no numbers or another width, sections without a name."""
    import random

    monkeypatch.setattr(V, "QUERY_BYTES", 256)
    monkeypatch.setattr(V, "CHUNK_BYTES", 256)
    rng = random.Random(3)
    some = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(12)]
    odd = [[0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [1e200] * 4, [1.0, 2.0], [], None]
    vector = lambda: rng.choice(odd) if rng.random() < 0.15 else [x * rng.choice([1, 1, 2, 0.1]) for x in rng.choice(some)]
    day = lambda: dt.datetime(2024, 1, rng.randint(1, 9))
    c = spark.createDataFrame([(rng.choice("pq"), rng.choice("uv"), rng.choice(["a", "b", "c", "\u00e9", None]), k, vector(), day()) for k in range(150)], "policy_id string, source_url string, section string, chunk_index int, vector array<double>, created_at timestamp")
    q = spark.createDataFrame([(k, rng.choice("pqr"), vector()) for k in range(60)], "query_id int, policy_id string, vector array<double>")
    scored = q.join(c.withColumnRenamed("vector", "chunk_vector"), "policy_id").withColumn("score", V.cosine(F.col("vector"), F.col("chunk_vector")))
    best = scored.groupBy("query_id", "source_url", "section").agg(F.max(F.struct("score", -F.col("chunk_index"), "created_at")).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b.score"), "source_url", "section")
    want = best.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("query_id", "rank", "source_url", "section", "b.score", (-F.col("b.col2")).alias("chunk_index"), "b.created_at")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(V.best_passages(q, c, 3)) == plain(want) and want.filter("score > 0.9").count() > 20
    assert V.best_passages(q.limit(0), c).count() == V.best_passages(q, c.limit(0)).count() == 0
    of_plan = V.best_passages(q, c)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in of_plan  # no row for each pair


def test_accuracy_and_cache(spark):
    v = spark.createDataFrame([("a", "k", "fail"), ("b", "k", "fail")], "store string, category string, verdict string")
    truth = spark.createDataFrame([("a", "k", "fail"), ("b", "k", "pass"), ("c", "k", "fail"), ("d", "k", "unknown"), ("e", "m", "pass")], v.schema)
    got = {r["category"]: r.asDict() for r in V.accuracy(v, truth, ["store", "category"]).collect()}
    assert (got["k"]["tp"], got["k"]["fp"], got["k"]["fn"], got["k"]["excluded"], got["k"]["precision"]) == (1, 1, 1, 1, 0.5) and got["m"]["precision"] is None
    day = lambda n: dt.datetime(2024, 3, n)
    cache = spark.createDataFrame([("x", "1", day(1)), ("x", "2", day(2)), ("y", "3", dt.datetime(2023, 1, 1))], "cache_key string, result_json string, created_at timestamp")
    work = spark.createDataFrame([("x",), ("y",), ("z",)], "cache_key string")
    now = F.lit("2024-03-10").cast("date")
    assert {r["cache_key"]: r["result_json"] for r in V.reuse(work, cache, now).collect()} == {"x": "2", "y": None, "z": None}
    at = lambda *t: F.lit(dt.datetime(2024, *t))
    assert [V.reuse(work.limit(1), cache, at(*t)).first()["hit"] for t in ((4, 1, 0, 0), (4, 1, 0, 1), (3, 1, 12, 0), (2, 28, 0, 0))] == [True, False, True, False]  # 30 days to the second, nothing from later
    asks = spark.createDataFrame([("x", "p", dt.datetime(2024, 3, 10, h)) for h in (0, 10, 14)] + [("x", "q", dt.datetime(2024, 3, 10))], "cache_key string, policy_id string, at timestamp")
    changes = spark.createDataFrame([("p", dt.datetime(2024, 3, 10, 12)), ("p", day(1)), ("q", day(2)), ("z", day(9))], "policy_id string, changed_at timestamp")
    assert {(r["policy_id"], r["at"].hour): r["result_json"] for r in V.reuse(asks, cache, F.col("at"), changes).collect()} == {("p", 0): "2", ("p", 10): "2", ("p", 14): None, ("q", 0): None}
    new = spark.createDataFrame([("x", "9", day(5))], cache.schema)
    assert {r["cache_key"]: r["result_json"] for r in V.upserted(cache, new).collect()} == {"x": "9", "y": "3"}


@pytest.mark.parametrize("size, priced, want", [(4, 4, 4), (200, 200, 10)])
def test_risk_sample_sizes(spark, size, priced, want):
    rows = [("s", "r", k, f"u{k}", float(k), 100 if k else 5) for k in range(size)]
    out = W.risk_sample(spark.createDataFrame(rows, "store_id string, run_id string, seq int, url string, price double, n_words int")).collect()
    assert len(out) == want and max(out, key=lambda r: r["score"])["url"] == "u0"
