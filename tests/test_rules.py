"""Rule evaluation on literal facts and pages."""

import pytest
from pyspark.sql import functions as F

from storegrain.operators import rules as R
from storegrain.plans.audit import rule, rule_table

FACT = "store_id string, run_id string, seq long, resource_url string, fact string, value string, method string, confidence double, variant_key string"
PAGE = "store_id string, run_id string, url string, page_type string"


def facts(spark, *rows):
    return spark.createDataFrame([("s", "r", k, *r, None)[:8] + (r[5] if len(r) > 5 else None,) for k, r in enumerate(rows)], FACT)


def cross(spark, rows, fact="return.window_days", sources=()):
    f = facts(spark, *[(f"u{k}", fact, v, "m", c) for k, (_, v, c) in enumerate(rows)])
    p = spark.createDataFrame([("s", "r", f"u{k}", t) for k, (t, _, _) in enumerate(rows)], PAGE)
    out = R.cross_page(f, p, rule_table(spark, rule(id="x", type="cross_page_contradiction", fact=fact, sources=list(sources)))).collect()
    return [(r["result"], round(r["confidence"], 2), r["distinct_values"]) for r in out]


def test_cross_page(spark):
    assert cross(spark, [("returns_policy", "30", 0.8), ("faq", "14", 0.8)]) == [("fail", 0.8, 2)]
    assert cross(spark, [("returns_policy", "30", 0.8)]) == []
    assert cross(spark, [("returns_policy", "30", 0.8), ("faq", "30.0", 0.8)]) == [("pass", 0.8, 1)]
    assert cross(spark, [("homepage", "US", 0.6), ("contact_about", "GB", 0.6)]) == [("needs_review", 0.6, 2)]
    assert cross(spark, [("a", "x", 0.9), ("b", "y", 0.9), ("c", "z", 0.9)], sources=["a", "b"]) == [("fail", 0.9, 2)]
    # each fact by its own comparison: prices within a cent, days as numbers, identifiers as they are, all else but for case and white space
    assert cross(spark, [("a", "19.99", 0.9), ("b", "19.995", 0.9)], "product.price_amount") == [("pass", 0.9, 1)] and cross(spark, [("a", "19.99", 0.9), ("b", "19.995", 0.9)]) == [("fail", 0.9, 2)]
    assert cross(spark, [("a", "0012", 0.9), ("b", "12", 0.9)], "product.gtin") == [("fail", 0.9, 2)] and cross(spark, [("a", "0012", 0.9), ("b", "12", 0.9)], "business.phone") == [("fail", 0.9, 2)]
    assert cross(spark, [("a", "Abc ", 0.9), ("b", "aBC", 0.9)], "business.name") == [("pass", 0.9, 1)]
    # classes are those of their first members: 1.016 is near 1.008 but not near 1.00
    assert cross(spark, [("a", "1.00", 0.9), ("b", "1.008", 0.9), ("c", "1.016", 0.9)], "shipping.cost_amount") == [("fail", 0.9, 2)]


def test_method_mismatch(spark):
    f = facts(
        spark, ("u", "price", "19.99", "jsonld", 0.95, "RED"), ("u", "price", "19.99", "api", 0.98, "RED"), ("u", "price", "24.99", "jsonld", 0.95, "BLUE"), ("u", "price", "29.99", "api", 0.98, "BLUE"),
        ("u", "price", "1", "jsonld", 0.95, "BLUE"), ("v", "price", "10", "jsonld", 0.95), ("w", "price", "50", "api", 0.98),
    )
    out = R.method_mismatch(f, rule_table(spark, rule(id="x", type="per_resource", fact="price", methods=["jsonld", "api"], tolerance=0.01))).collect()
    assert {(r["resource_url"], r["variant_key"]): r["result"] for r in out} == {("u", "RED"): "pass", ("u", "BLUE"): "fail"}


def test_missing(spark):
    runs = spark.createDataFrame([("s", "r", False, ["returns_policy"]), ("t", "r", True, []), ("u", "r", False, [])], "store_id string, run_id string, failed boolean, credited array<string>")
    f = facts(spark, ("u", "business.email", "a@b.cd", "m", 0.9))
    table = rule_table(spark, rule(id="c", type="all_missing", fields=["business.email"]), rule(id="both", type="all_missing", fields=["business.phone", "business.email"]))
    got = lambda credited=None: {(r["store_id"], r["rule_id"]): (r["result"], r["confidence"]) for r in R.missing_facts(runs, f, table, credited).collect()}
    assert got() == {("s", "c"): ("pass", 1.0), ("t", "c"): ("needs_review", 0.0), ("u", "c"): ("fail", 1.0), ("s", "both"): ("pass", 1.0), ("t", "both"): ("needs_review", 0.0), ("u", "both"): ("fail", 1.0)}
    credited = got(runs.select("store_id", "run_id"))
    assert credited["u", "both"] == ("pass", 0.8) and credited["u", "c"] == ("fail", 1.0) and credited["s", "both"] == ("pass", 1.0)
    pages = spark.createDataFrame(
        [("s", "r", "faq", True, False, False), ("u", "r", "faq", True, True, False), ("u", "r", "cart", False, False, True), ("t", "r", "faq", True, False, False)], "store_id string, run_id string, page_type string, reachable boolean, soft_404 boolean, cannot_verify boolean"
    )
    table = rule_table(spark, *[rule(id=t, resource_type=t) for t in ("faq", "returns_policy", "cart")])
    got = {(r["store_id"], r["resource_type"]): (r["result"], r["reason"], r["confidence"]) for r in R.missing_resource(runs, pages, table).collect()}
    assert got["s", "faq"] == ("pass", "genuine", 1.0) and got["u", "faq"] == ("needs_review", "soft_404", 0.5) and got["u", "cart"] == ("needs_review", "blocked", 0.3) and got["t", "faq"] == ("needs_review", "crawl_failed", 0.0)
    assert got["s", "returns_policy"] == ("pass", "credited", 0.8) and got["u", "returns_policy"] == ("fail", "absent", 1.0)


def test_rule_errors(spark):
    sound = [
        rule(id="a", type="numeric_mismatch", fact="known", methods=["m", "n"], tolerance=0.01, source_url="https://support.google.com/x"), rule(id="b", type="cross_page_contradiction", fact="known", sources=["faq"]), rule(id="c", type="missing_resource", resource_type="faq"),
        rule(id="d", type="all_missing", fields=["known"], impact="quality_improvement"), rule(id="e", type="existing_check", check="x"),
    ]
    broken = {
        "no type": rule(id="1"), "type": rule(id="2", type="guess"), "fact": rule(id="3", type="all_missing", fields=["known", "unknown"]), "method": rule(id="4", type="numeric_mismatch", fact="known", methods=["m", "zzz"], tolerance=0.1), "three": rule(id="5", type="numeric_mismatch", fact="known", methods=["m", "n", "m"], tolerance=0.1),
        "tolerance": rule(id="6", type="numeric_mismatch", fact="known", methods=["m", "n"]), "sources": rule(id="7", type="cross_page_contradiction", fact="known"), "page type": rule(id="8", type="missing_resource", resource_type="nope"), "source type": rule(id="9", type="cross_page_contradiction", fact="known", sources=["nope"]),
        "host": rule(id="10", type="existing_check", check="x", source_url="https://google.com.example/"), "scheme": rule(id="11", type="existing_check", check="x", source_url="http://google.com/"), "advisory": rule(id="12", type="existing_check", check="x", impact="quality_improvement", policy_reference="p"), "check": rule(id="13", type="existing_check"),
    }
    registry = spark.createDataFrame([("known",)], "fact string")
    errors = lambda *rules: sorted(tuple(r) for r in R.rule_errors(rule_table(spark, *rules), registry, ["m", "n"]).collect())
    assert errors(*sound) == []
    assert sorted({e[0] for e in errors(*broken.values())}, key=int) == [str(k) for k in range(1, 14)]
    assert errors(sound[0], sound[0]) == [("a", "duplicate id")] and ("7", "cross_page_contradiction needs sources") in errors(broken["sources"])


def test_sync_and_status(spark):
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "id int, title string"), spark.createDataFrame([(2, "z"), (3, "w")], "id int, title string")
    assert sorted(tuple(r) for r in R.sync_rules(old, new).collect()) == [(1, "x", False), (2, "z", True), (3, "w", True)]
    runs = spark.createDataFrame([(s, "r") for s in "stuv"], "store_id string, run_id string")
    ev = spark.createDataFrame([("s", "r", "a", "fail"), ("s", "r", "gone", "fail"), ("t", "r", "b", "needs_review"), ("t", "r", "low", "fail"), ("u", "r", "a", "pass"), ("v", "r", "advice", "fail")], "store_id string, run_id string, rule_id string, result string")
    table = rule_table(spark, rule(id="a", severity="critical"), rule(id="b", severity="high"), rule(id="low", severity="low"), rule(id="advice", severity="critical", impact="quality_improvement"))
    f = R.build_findings(ev, table)
    assert {r["store_id"]: (r["status"], r["n_findings"]) for r in R.snapshot_status(runs, f).collect()} == {"s": ("CRITICAL", 1), "t": ("AT_RISK", 2), "u": ("COMPLIANT", 0), "v": ("COMPLIANT", 1)}
    assert {(r["rule_id"], r["risk_level"], r["consequence"]) for r in f.collect()} == {("a", "suspension_risk", R.CONSEQUENCE["critical"]), ("b", "serious_risk", R.CONSEQUENCE["high"]), ("low", "minor_issue", R.CONSEQUENCE["low"]), ("advice", "advisory", R.ADVISORY)}


@pytest.mark.parametrize("cls, want", [("confirmed", ("fail", 1.0)), ("potential_risk", ("fail", 0.85)), ("cannot_verify", ("needs_review", 0.3))])
def test_existing_checks(spark, cls, want):
    runs = spark.createDataFrame([("s", "r"), ("t", "r")], "store_id string, run_id string")
    checks = {"c": lambda pages, rs: rs.filter("store_id = 's'").withColumn("confidence", F.lit(cls)), "broken": lambda pages, rs: rs.select("no such column")}
    out, errors = R.existing_checks(checks, runs, runs, rule_table(spark, rule(id="x", check="c"), rule(id="y", check="not there"), rule(id="z", check="broken")))
    assert [(r["store_id"], r["rule_id"], r["result"], r["confidence"]) for r in out.collect()] == [("s", "x", *want)]
    assert sorted(name for name, _ in errors) == ["broken", "not there"]


def test_a_bad_rule_stops_no_other(spark):
    runs = spark.createDataFrame([("s", "r", False, ["faq"])], "store_id string, run_id string, failed boolean, credited array<string>")
    f = facts(spark, ("u0", "known", "1", "m", 0.9), ("u1", "known", "2", "n", 0.9), ("u1", "known", "3", "m", 0.9))
    pages = spark.createDataFrame([("s", "r", u, "faq", True, False, False) for u in ("u0", "u1")], PAGE + ", reachable boolean, soft_404 boolean, cannot_verify boolean")
    rules = [
        rule(id="cross", type="cross_page_contradiction", fact="known", sources=["faq"]), rule(id="mismatch", type="numeric_mismatch", fact="known", methods=["m", "n"], tolerance=0.1), rule(id="page", type="missing_resource", resource_type="faq"), rule(id="facts", type="all_missing", fields=["known"]),
        rule(id="check", type="existing_check", check="c"), rule(id="gone", type="existing_check", check="gone"), rule(id="bad", type="all_missing", fields=["unknown"]),
    ]
    registry = spark.createDataFrame([("known",)], "fact string")
    checks = {"c": lambda p, r: p.filter("url = 'u0'").select("store_id", "run_id", F.lit("confirmed").alias("confidence"), F.col("url").alias("page_url"))}
    out, errors = R.evaluate(rule_table(spark, *rules), f, pages, runs, registry, ["m", "n"], checks)
    assert {(r["rule_id"], r["resource_url"], r["result"]) for r in out.collect()} == {("cross", None, "fail"), ("mismatch", "u1", "fail"), ("page", None, "pass"), ("facts", None, "pass"), ("check", "u0", "fail")}
    assert {r["id"] for r in errors.collect()} == {"gone", "bad"}
    out, errors = R.evaluate(rule_table(spark, rules[-1]), f, pages, runs, registry, ["m", "n"])
    assert out.count() == 0 and errors.count() == 1


def test_evidence_in_words(spark):
    seen = "array<struct<label:string,value:string,source_url:string,method:string,confidence:double>>"
    d = spark.createDataFrame([([("faq", "30", "u", "regex", 0.8), (None, "14", "v", "api", 0.987)], "blocked", "faq", ["u", "v"]), (None, "absent", None, None)], f"o {seen}, reason string, kind string, urls array<string>")
    got = d.select(R.comparison_text(F.col("o")).alias("a"), R.missing_text(F.col("reason"), F.col("kind"), F.col("urls")).alias("b"), R.all_missing_text(F.array(F.lit("x"), F.lit("y"))).alias("c")).collect()
    assert got[0]["a"] == 'faq shows "30" (u, regex, confidence 0.80); api shows "14" (v, api, confidence 0.99)' and got[1]["a"] == "No comparable evidence recorded."
    assert got[0]["b"].startswith("A likely faq page was found but could not be read: u, v.") and got[1]["b"] == "No reachable required page was found anywhere on the site." and got[0]["c"].endswith("site: x, y.")


def test_extraction(spark):
    from storegrain.operators import extract as E

    home = "Shop by Acme Widgets. © 2024 Acme Widgets Ltd. All rights reserved\nCall +44 20 7946 0958 or mail info@acme.example. We ship worldwide. We take Visa and PayPal"
    policy = "Returns are accepted within 30 days. Full refund. Free returns for all.\nProcessing time is 1-2 business days"
    both = "operated by Big Corp. Copyright 2020 Small Ltd. Reach +1 212 555 0100 or +49 30 1234567 in Canada"
    rows = [("s", "r", 0, "h", "homepage", ["Contact us", "x" * 61, " Acme "], home), ("s", "r", 1, "p", "returns_policy", [], policy), ("s", "r", 2, "n", "terms_of_service", None, None), ("s", "r", 3, "c", "contact_about", None, both), ("s", "r", 4, "d", "product", ["Acme"], home)]
    p = spark.createDataFrame(rows, "store_id string, run_id string, seq long, url string, page_type string, headings array<string>, text string")
    f = E.extract_facts(p)
    got = {}
    for r in f.collect():
        got.setdefault((r["resource_url"], r["fact"], r["method"]), []).append(r["value"])
    assert got["h", "business.legal_entity", "copyright_footer_regex"] == ["Acme Widgets Ltd."] and got["h", "business.name", "copyright_footer_regex"] == ["Acme Widgets"] and got["h", "business.name", "heading_heuristic"] == ["Acme"]
    assert got["c", "business.legal_entity", "legal_suffix_regex"] == ["Big Corp."] and got["c", "business.name", "legal_suffix_regex"] == ["Big"] and ("c", "business.name", "copyright_footer_regex") not in got
    assert got["h", "business.address_country", "calling_code_cross_reference"] == ["GB"] and got["h", "shipping.region", "shipping_region_regex"] == ["WORLDWIDE"] and got["h", "payment.methods", "payment_methods_keyword_regex"] == ["PAYPAL,VISA"]
    assert sorted(got["c", "business.address_country", "calling_code_cross_reference"]) == ["DE", "US"] and got["c", "business.address_country", "address_text_country_regex"] == ["CA"]
    assert got["p", "return.window_days", "return_window_regex"] == ["30"] and got["p", "return.refund_terms", "refund_terms_keyword_classifier"] == ["full_refund"] and got["p", "return.cost_responsibility", "return_cost_keyword_classifier"] == ["merchant_pays"]
    # contacts come from identity pages only, pages without a text or that didn't load have no facts
    assert ("p", "shipping.processing_days", "shipping_time_regex") not in got and not [k for k in got if k[0] == "n" or (k[0] == "d" and k[1].startswith("business."))]
    assert E.unknown_methods(f).count() == 0 and E.extract_facts(p.withColumn("reachable", F.lit(False))).count() == 0


def test_classes_within_a_tolerance(spark):
    import random

    rng = random.Random(7)
    rows, want = [], {}
    for key, n, make in (("a", 300, lambda: round(rng.uniform(0, 3), 2)), ("b", 60, lambda: rng.choice([0.28, 0.29, 0.3, 0.31, -0.0, 0.01])), ("c", 40, None), ("d", 1, lambda: 5.0)):
        values = list(dict.fromkeys(make() for _ in range(n))) if make else [k / 1000 * 9.9 for k in range(n)]  # a chain
        rows += [(key, v, k, 0.01) for k, v in enumerate(values)]
        found = []
        for v in values:
            if not any(abs(v - x) <= 0.01 for x in found):
                found.append(v)
        want[key] = sorted(found)
    from storegrain.operators.classes import leaders

    got = {}
    df = spark.createDataFrame(rows, "k string, value double, seq long, tolerance double")
    for r in leaders(df, ["k"]).collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert leaders(df.limit(0), ["k"]).count() == 0


def test_texts_of_two_methods_agree_only_as_they_are(spark):
    rows = [("s", "r", k, f"u{k}", "product.availability", v, m, 0.9, None) for k, (a, b) in enumerate([("in_stock", "in_stock"), ("In Stock", "in stock"), ("in  stock", "in stock"), ("5.00", "5.004")]) for v, m in ((a, "jsonld"), (b, "platform_api"))]
    f = spark.createDataFrame(rows, "store_id string, run_id string, seq long, resource_url string, fact string, value string, method string, confidence double, variant_key string")
    r = rule_table(spark, rule(id="x", type="numeric_mismatch", fact="product.availability", methods=["jsonld", "platform_api"], tolerance=0.01))
    assert [x["result"] for x in R.method_mismatch(f, r).orderBy("resource_url").collect()] == ["pass", "fail", "fail", "pass"]
