"""Streams and landed files, through a temporary folder."""

import json

from pyspark.sql import functions as F

from storegrain.operators import findings as N
from storegrain.sources import tables as T
from storegrain.streaming import jobs as S


def test_admit():
    assert S.admit([0, 1, 2, 9.9, 10, 11.5], 2, 10)[0] == [True, True, False, False, True, True]


def test_admission_stream_is_the_batch(spark, tmp_path):
    rows = [(k % 3, f"2024-01-01 00:00:{k:02d}", k) for k in range(40)]
    e = spark.createDataFrame(rows, "key long, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        out = S.run_to_end(spark, S.admissions(stream, 2, 10.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r["event_id"]: r["admitted"] for r in S.admissions_batch(e, 2, 10.0).collect()}
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == want and 0 < sum(want.values()) < 40


def test_findings_are_kept_current(spark, tmp_path):
    """Any split into batches gives what one batch gives, and a batch reads and writes its own rows only."""
    import random

    rng = random.Random(5)
    schema = "store_id string, run_id string, seq long, check_id string, title string, severity string, confidence string, page_url string, evidence string, location string"
    checks = [*list(N.STRATEGY)[:3], *list(N.SUSPENSION_CHECKS)[:1], *list(N.QUALITY_CHECKS)[:1], "other"]
    rows = [
        (rng.choice("ab"), "7", k, rng.choice(checks), f"t{k}", rng.choice(["critical", "high", "low"]), rng.choice(["confirmed", "cannot_verify"]), rng.choice([None, *"pqrs"]), "e", rng.choice([None, '<a href="https://x.example/1">', '<a href="https://y.example/2">', '<img src="i">']))
        for k in range(240)
    ]
    rng.shuffle(rows)
    paths = {x: str(tmp_path / x) for x in ("in", "store", "parts", "counts", "cp")}
    for k in range(4):
        spark.createDataFrame(rows[60 * k : 60 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(paths["in"])
        before = {f for f in tmp_path.glob("parts/**/*.parquet")}
        S.keep_current(spark.readStream.schema(schema).parquet(paths["in"]), paths["store"], paths["parts"], paths["counts"], paths["cp"]).awaitTermination()
        assert before <= {f for f in tmp_path.glob("parts/**/*.parquet")}
        new = spark.read.parquet(paths["parts"]).filter(F.col("batch") == k)
        assert new.agg(F.sum("n")).first()[0] <= 60
    every = spark.createDataFrame(rows, schema)
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = plain(N.rolled_up(every))
    assert plain(S.current_rollups(spark, paths["store"], paths["parts"])) == want and any("n=1" not in x for x in want)
    runs = spark.createDataFrame([("a", "7", False), ("b", "7", False), ("c", "7", True)], "store_id string, run_id string, failed boolean")
    assert plain(S.current_scores(spark, paths["counts"], runs)) == plain(N.risk_score(runs, N.with_impact(every)))
    other = {f: f.stat().st_mtime_ns for f in tmp_path.glob("parts/store_id=b/**/*.parquet")}
    S.compact(spark, paths["parts"], runs.filter("store_id = 'a'"))
    assert plain(S.current_rollups(spark, paths["store"], paths["parts"])) == want
    assert {f.name for f in (tmp_path / "parts/store_id=a/run_id=7").iterdir()} == {"batch=-1"}
    assert {f: f.stat().st_mtime_ns for f in tmp_path.glob("parts/store_id=b/**/*.parquet")} == other


def test_runs_share_the_folders_of_their_buckets(spark, tmp_path):
    """Sixty runs in two batches and four buckets: few files, the same rollups and scores, also of two runs alone and after one is compacted."""
    schema = "store_id string, run_id string, seq long, check_id string, title string, severity string, confidence string, page_url string, evidence string, location string"
    rows = [(f"{k % 60:03d}", "7", k, ["external_domain_link", "broken_image", "other"][k // 60 % 3], f"t{k}", ["critical", "high", "low"][k // 180 % 3], "confirmed", f"p{k % 7}", "e", f'<a href="https://x.example/{k % 2}">') for k in range(1200)]
    paths = {x: str(tmp_path / x) for x in ("in", "store", "parts", "counts", "cp")}
    for k in range(2):
        spark.createDataFrame(rows[600 * k : 600 * (k + 1)], schema).write.mode("append").parquet(paths["in"])
        S.keep_current(spark.readStream.schema(schema).parquet(paths["in"]), paths["store"], paths["parts"], paths["counts"], paths["cp"], buckets=4).awaitTermination()
    for x in ("store", "parts", "counts"):
        assert len(list(tmp_path.glob(f"{x}/**/*.parquet"))) == 8
    every = spark.createDataFrame(rows, schema)
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    runs = every.select("store_id", "run_id").distinct().withColumn("failed", F.lit(False))
    two, of_two = runs.filter("store_id in ('003', '004')"), every.filter("store_id in ('003', '004')")
    assert plain(S.current_scores(spark, paths["counts"], runs, buckets=4)) == plain(N.risk_score(runs, N.with_impact(every)))
    assert plain(S.current_scores(spark, paths["counts"], two, buckets=4)) == plain(N.risk_score(two, N.with_impact(of_two)))
    want = plain(N.rolled_up(every))
    assert plain(S.current_rollups(spark, paths["store"], paths["parts"], buckets=4)) == want and any("n=1" not in x for x in want)
    S.compact(spark, paths["parts"], runs.filter("store_id = '003'"), buckets=4)
    assert len(list(tmp_path.glob("parts/**/*.parquet"))) == 7 and len(list(tmp_path.glob("parts/bucket=*/batch=-1"))) == 1
    assert plain(S.current_rollups(spark, paths["store"], paths["parts"], buckets=4)) == want
    assert plain(S.current_rollups(spark, paths["store"], paths["parts"], two, buckets=4)) == plain(N.rolled_up(of_two))


def test_idle_keys_leave_no_state(spark, tmp_path):
    """Five batches, of which the later ones move the watermark on; results are those of the whole table."""
    when = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(k % 4, when(k), k) for k in range(24)], [(0, when(k), 100 + k) for k in range(30, 50, 2)], [(0, when(300), 200)], [(0, when(301), 201)], [(0, when(302), 202)]]
    schema, found = "key long, ts string, event_id long", []
    stream_schema = "key long, ts timestamp, event_id long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b in batches:
            spark.createDataFrame(b, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = S.run_to_end(spark, S.admissions(spark.readStream.schema(stream_schema).parquet(str(tmp_path / "in")), 2, 10.0, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
            state = spark.read.format("statestore").option("stateVarName", "accepted").load(str(tmp_path / "cp"))
            found.append(sorted({r["key"]["key"] for r in state.select("key").collect()}))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert found[0] == [0, 1, 2, 3] and found[-1] == [0]
    every = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == {r["event_id"]: r["admitted"] for r in S.admissions_batch(every, 2, 10.0).collect()}


def test_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int")
    T.write_buckets(old, path, ["k"], 16)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("**/*.parquet")}
    rows = lambda: {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    before, newest = files(), lambda o, n: o.withColumn("s", F.lit(0)).unionByName(n.withColumn("s", F.lit(1))).groupBy("k").agg(F.max_by("v", "s").alias("v"))
    new = spark.createDataFrame([("k3", -3), ("new", 7)], old.schema)
    T.merge_buckets(new, path, ["k"], newest, 16)
    assert rows() == {f"k{i}": i for i in range(200)} | {"k3": -3, "new": 7}
    kept = [f for f, t in files().items() if before.get(f) == t]
    assert len({f.parent for f in before} - {f.parent for f in kept}) <= 2 and len(kept) >= 14
    T.merge_buckets(new.limit(0), path, ["k"], newest, 16)
    before, after = files(), spark.read.parquet(path).drop("bucket").filter("k <> 'k9'").withColumn("v", F.when(F.col("k") == "k8", 0).otherwise(F.col("v")))
    after = spark.createDataFrame(after.collect(), old.schema)
    T.replace_changed_buckets(after, path, ["k"], 16)
    assert rows() == {f"k{i}": i for i in range(200) if i != 9} | {"k3": -3, "new": 7, "k8": 0}
    assert len([f for f, t in files().items() if before.get(f) == t]) >= 14
    T.replace_changed_buckets(after.filter("k = 'k1'"), path, ["k"], 16)
    assert rows() == {"k1": 1}


def test_due_list(spark, tmp_path):
    stores = spark.createDataFrame([("a", "interval", 3, None, None, None), ("b", "on_change", None, None, None, None)], "url string, mode string, interval_days int, last_full_audit_at timestamp, cheap_check_interval_days int, last_cheap_check_at timestamp")
    spark.range(1).write.parquet(str(tmp_path / "in"))
    S.write_due(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), stores, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_new_alerts(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "product_id int, rule string")
    assert sorted(tuple(r) for r in S.new_alerts(v, v.filter("rule = 'b'")).collect()) == [(1, "a"), (2, "a")]


def test_sitemap_walk(spark, tmp_path):
    """An index names two documents and itself, one of them is an index too; its child's child is too deep."""
    from urllib.parse import quote

    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    pages = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    docs = {"https://a/0": index("https://a/0", "https://a/1", "https://a/2"), "https://a/1": pages("https://a/x", "https://a/y"), "https://a/2": index("https://a/3"), "https://a/3": pages("https://a/y", "https://a/z"), "https://a/4": pages("https://a/not-linked"), "https://a/5": index("https://a/2")}
    (tmp_path / "maps").mkdir()
    for url, text in docs.items():
        (tmp_path / "maps" / f"{quote(url, safe='')}.xml").write_text(text)
    walk = lambda url: {r["loc"]: r["depth"] for r in T.sitemap_walk(spark, str(tmp_path / "maps"), spark.createDataFrame([(url,)], "url string")).collect()}
    assert walk("https://a/0") == {"https://a/x": 1, "https://a/y": 1, "https://a/z": 2} and walk("https://a/5") == {"https://a/y": 2, "https://a/z": 2} and walk("https://a/1") == {"https://a/x": 0, "https://a/y": 0}


def test_landed_files(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps/a.xml").write_text("<urlset><url><loc>https://a/1</loc></url><url><loc>https://a/2</loc></url></urlset>")
    (tmp_path / "maps/b.xml").write_text("<sitemapindex><sitemap><loc>https://a/m.xml</loc></sitemap></sitemapindex>")
    assert {r["loc"] for r in T.sitemap_urls(spark, str(tmp_path / "maps")).collect()} == {"https://a/1", "https://a/2"}
    assert [r["loc"] for r in T.sitemap_children(spark, str(tmp_path / "maps")).collect()] == ["https://a/m.xml"]
    (tmp_path / "s.json").write_text(json.dumps({"products": [{"handle": "w", "variants": [{"price": "1.00", "available": True}]}]}))
    assert T.shopify_products(spark, str(tmp_path / "s.json")).first()["variants"][0]["price"] == "1.00"
    from storegrain.operators.catalog_match import normalized_feed

    raw = [
        {"id": 1, "name": "n", "price": "", "regular_price": "5.00", "sku": "S-1", "weight": "2.5", "dimensions": {"length": "3", "width": "", "height": None}, "meta_data": [{"key": "_EAN", "value": "123"}, {"key": "gtin", "value": "9"}, {"key": "condition", "value": "Used"}], "categories": [{"name": "Toys"}, {"name": "Espresso & Coffee"}], "attributes": [{"key": "color", "value": "red"}], "images": [{"src": "i"}, {"src": ""}], "stock_status": "instock"},
        {"id": 2, "short_description": "s", "price": "x", "meta_data": [{"key": "condition", "value": "broken"}], "categories": [{"slug": "motor-parts"}], "stock_status": "onbackorder"}, {"id": 3, "price": "7"},
    ]
    (tmp_path / "w.json").write_text(json.dumps(raw))
    a, b, c = normalized_feed(T.woocommerce_products(spark, str(tmp_path / "w.json"))).orderBy("id").collect()
    assert (a["id"], a["source_id"], a["price"], a["landing_page_price"], a["gtin"], a["mpn"], a["category"], a["condition"], a["availability"], a["shipping_weight_kg"], a["attributes"], len(a["images"])) == ("woocommerce-1", "1", 5.0, 5.0, "123", "S-1", "coffee_machine", "used", "in_stock", 2.5, {"color": "red"}, 1)
    assert tuple(a["shipping_dims_cm"]) == (3.0, 0.0, 0.0)
    assert (b["title"], b["description"], b["price"], b["category"], b["condition"], b["availability"], b["shipping_dims_cm"]) == ("", "s", None, "electric_motor", "new", "onbackorder", None)
    assert (c["price"], c["category"], c["availability"], c["gtin"]) == (7.0, "household_tool", "out_of_stock", None)
    (tmp_path / "l.json").write_text(json.dumps([{"store_url": "s", "platform": "p", "ground_truth": {"k": {"verdict": "pass", "notes": ""}, "m": {"verdict": "fail", "notes": "x"}}}]))
    assert {(r["category"], r["verdict"]) for r in T.ground_truth(spark, str(tmp_path / "l.json")).collect()} == {("k", "pass"), ("m", "fail")}
    rows = spark.createDataFrame([([1, 2],)], "a array<int>")
    texts = T.write_json_columns(rows, ["a"])
    assert texts.first()["a"] == "[1,2]" and T.read_json_columns(texts.unionByName(spark.createDataFrame([("no",)], "a string")), {"a": "array<int>"}).collect() == [([1, 2],), (None,)]


def test_tables_out(spark, tmp_path):
    facts = spark.createDataFrame([("s", "r", "u1", "f", "v"), ("s", "r", "gone", "f", "v")], "store_id string, run_id string, resource_url string, fact string, value string")
    pages = spark.createDataFrame([("s", "r", "u1")], "store_id string, run_id string, url string")
    T.append_facts(facts, pages, str(tmp_path / "facts"))
    assert [r["resource_url"] for r in spark.read.parquet(str(tmp_path / "facts")).collect()] == ["u1"]
    chunks = spark.createDataFrame([("p", "a"), ("q", "b")], "policy_id string, chunk_text string")
    T.replace_policies(chunks, str(tmp_path / "chunks"))
    T.replace_policies(chunks.filter("policy_id = 'q'").withColumn("chunk_text", F.lit("new")), str(tmp_path / "chunks"))
    assert {(r["policy_id"], r["chunk_text"]) for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {("p", "a"), ("q", "new")}
    chunks.write.parquet(str(tmp_path / "e/1"))
    chunks.withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "e/2"))
    assert "more" in T.read_evolved(spark, str(tmp_path / "e/*")).columns
    N.export_csv(spark.createDataFrame([("c", "a, b", None)], "check_id string, title string, page_url string"), str(tmp_path / "csv"))
    row = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert row.asDict().keys() == set(N.EXPORT) and (row["check_id"], row["title"], row["page_url"]) == ("c", "a, b", None)


def test_stored_rules_snapshots_and_verdicts(spark, tmp_path):
    import datetime as dt

    from storegrain.operators import history as H
    from storegrain.operators import retrieval as V
    from storegrain.operators import rules as R

    day = lambda n: dt.datetime(2024, 1, n)
    at = lambda x: str(tmp_path / x)
    times = lambda x: {f: f.stat().st_mtime_ns for f in (tmp_path / x).glob("**/*.parquet")}
    kept = lambda x, before: len([f for f, t in times(x).items() if before.get(f) == t])
    rules = spark.createDataFrame([(f"r{k}", f"t{k}") for k in range(40)], "id string, title string")
    T.write_buckets(rules.withColumn("active", F.lit(True)), at("rules"), ["id"], 8)
    before = times("rules")
    R.store_rules(rules.filter("id <> 'r3'").withColumn("title", F.when(F.col("id") == "r5", "new").otherwise(F.col("title"))), at("rules"), 8)
    got = {r["id"]: (r["title"], r["active"]) for r in spark.read.parquet(at("rules")).collect()}
    assert got == {f"r{k}": (f"t{k}", True) for k in range(40)} | {"r3": ("t3", False), "r5": ("new", True)} and kept("rules", before) >= 6
    pages = spark.createDataFrame([("s", f"u{k}", "h", day(2)) for k in range(40)], "store_id string, url string, content_hash string, fetched_at timestamp")
    T.write_buckets(pages, at("pages"), ["store_id", "url"], 8)
    before = times("pages")
    H.store_snapshots(pages.filter("url = 'u7'").withColumns({"content_hash": F.lit("g"), "fetched_at": F.lit(day(3))}), at("pages"), ["store_id", "url"], 8)
    assert {r["url"] for r in spark.read.parquet(at("pages")).filter("content_hash = 'g'").collect()} == {"u7"} and spark.read.parquet(at("pages")).count() == 40 and kept("pages", before) >= 7
    cache = spark.createDataFrame([(f"k{k}", "1", day(2)) for k in range(40)], "cache_key string, result_json string, created_at timestamp")
    T.write_buckets(cache, at("cache"), ["cache_key"], 8)
    before = times("cache")
    V.store_verdicts(cache.filter("cache_key = 'k1'").withColumns({"result_json": F.lit("2"), "created_at": F.lit(day(1))}), at("cache"), 8)  # an older one
    V.store_verdicts(cache.filter("cache_key = 'k2'").withColumns({"result_json": F.lit("2"), "created_at": F.lit(day(9))}), at("cache"), 8)
    assert {r["cache_key"] for r in spark.read.parquet(at("cache")).filter("result_json = '2'").collect()} == {"k2"} and kept("cache", before) >= 6
