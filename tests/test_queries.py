"""Every registered query outside the training-data subpackage against DuckDB, on the smallest tables."""

import difflib

import pytest
from conftest import rows_of

import __spark_entry__ as entry
from storegrain import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, sf_dir).toPandas()) == duck(catalog.SQL[name])


def test_price_classes_are_those_of_a_loop(spark, sf_dir):
    want, by_mode = [], {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_returnflag", "round(l_extendedprice / l_quantity, 2) as v", "l_orderkey * 10 + l_linenumber as seq").orderBy("seq").collect():
        by_mode.setdefault(r["l_returnflag"], []).append((r["seq"], r["v"]))
    for mode, rows in by_mode.items():
        found = []
        for seq, v in rows:
            if not any(abs(v - x) <= 1.5 for x in found):
                found.append(v)
                want.append((mode, v, seq))
    assert sorted((r["l_returnflag"], r["value"], r["seq"]) for r in catalog.QUERIES["price_classes"](spark, sf_dir).collect()) == sorted(want)


def test_near_titles_are_those_of_brute_force(spark, sf_dir):
    docs = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"] is not None}
    first = {}  # of equal titles the first by number
    for url in sorted(docs, key=int):
        first.setdefault(" ".join(docs[url].split("\n")[0].split()).lower(), url)
    titles, want = sorted((t, u) for t, u in first.items() if t), set()
    for i, (x, a) in enumerate(titles):
        for y, b in titles[i + 1 :]:
            m = difflib.SequenceMatcher(None, *((x, y) if int(a) < int(b) else (y, x)))
            if x.split()[0] == y.split()[0] and m.quick_ratio() >= 0.92 and m.ratio() >= 0.92:
                want.add(frozenset((a, b)))
    assert {frozenset((r["url_a"], r["url_b"])) for r in catalog.QUERIES["near_duplicate_titles"](spark, sf_dir).collect()} == want


def test_soft_404s_are_those_of_brute_force(spark, sf_dir):
    by_source, want = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        by_source.setdefault(r["source"], []).append((r["doc_id"], " ".join((r["text"] or "").split())))
    for source, rows in by_source.items():
        odd = [t for i, t in rows if i % 2]
        for i, t in rows:
            for name, base in (("baseline", odd[0] if odd else None), ("homepage", rows[0][1] if i != rows[0][0] else None)):
                if base is None or (source, str(i)) in want:
                    continue
                short, long = sorted((len(t), len(base)))
                near = short and 2 * short / (short + long) >= 0.92 and difflib.SequenceMatcher(None, t.lower(), base.lower()).ratio() >= 0.92
                if t == base or near:
                    want[source, str(i)] = (name, "exact" if t == base else "near")
    assert {(r["store_id"], r["url"]): (r["matched"], r["how"]) for r in catalog.QUERIES["soft404_near"](spark, sf_dir).collect()} == want


def test_admissions_are_those_of_a_plain_loop(spark, sf_dir):
    accepted, want = {}, {}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id is not null").select("user_id", "ts", "event_id").collect()
    for user, ts, event in sorted((r["user_id"], r["ts"].timestamp(), r["event_id"]) for r in rows):
        recent = [t for t in accepted.get(user, []) if ts - t < 86_400]
        want[event] = len(recent) < 2
        accepted[user] = recent + [ts] * want[event]
    assert {r["event_id"]: r["admitted"] for r in catalog.QUERIES["admission_limit"](spark, sf_dir).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
