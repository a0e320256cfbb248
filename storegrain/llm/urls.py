"""URL rules looked up in a sorted digest array.

A rule is a host and the start of a path. The index holds the 64-bit xxhash of every rule string in order, with
the strings themselves. A worker memory-maps it, probes it by binary search with all host suffixes and path
starts of a batch of URLs at once, and compares the strings of what it finds, so equal digests do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import ascii_lower, free_name, new_path, written

#: The rules of the registered query, (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PARTS = r"(?s)://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


class DigestIndex:
    """Sorted uint64 digests, their strings in the same order, and a verdict each, in one file that is memory-mapped.

    The file: the numbers of rules and of path lengths, then digests, ends of the strings, verdicts' numbers, path
    lengths (all of 8 bytes), then the strings and, at the end of their own, the verdicts' names.
    """

    @staticmethod
    def packed(rows: list[tuple[str, str, str]]) -> bytes:
        """The file's content. rows: (host, path, verdict); of equal rules the last counts."""
        found = {h + p: (h, p, v) for h, p, v in rows}
        order = sorted(found, key=lambda r: (xxhash.xxh64_intdigest(r.encode()), r))
        lengths, names = sorted({len(found[r][1]) for r in order}), sorted({v for _, _, v in found.values()})
        texts = [r.encode() for r in order]
        numbers = [len(order), len(lengths), len(names)], [xxhash.xxh64_intdigest(t) for t in texts], np.cumsum([0, *map(len, texts)]), [names.index(found[r][2]) for r in order], lengths
        kinds = np.int64, np.uint64, np.int64, np.int64, np.int64
        return b"".join([*[np.array(x, k).tobytes() for x, k in zip(numbers, kinds, strict=True)], *texts, "\0".join(names).encode()])

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, n_lengths, _ = whole[:24].view(np.int64).tolist()
        at = [24, *(24 + 8 * np.cumsum([n, n + 1, n, n_lengths])).tolist()]
        self.keys, self.ends, self.verdict, lengths = (whole[a:b].view(np.uint64 if k == 0 else np.int64) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
        self.lengths = lengths.tolist()
        self.text = whole[at[-1] :]
        self.names = self.text[int(self.ends[-1]) :].tobytes().decode().split("\0")

    def string(self, k: int) -> str:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes().decode()

    def probe(self, strings: list[str]) -> np.ndarray:
        """Row of each string in the index, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings], dtype=np.uint64)
        out = np.full(len(strings), -1)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.string(k) == strings[i]:
                    out[i] = k
                    break
                k += 1
        return out


def suffixes(h: str, longest: int) -> list[str]:
    """The host and its parent domains, longest first, of those with `longest` characters at most: no other is the host of a rule."""
    out, at = [h] if len(h) <= longest else [], max(0, len(h) - longest - 1)
    while (at := h.find(".", at) + 1) > 0:
        out.append(h[at:])
    return out


def judge(urls: DataFrame, rules: DataFrame, *, default: str = "allow", most_rules: int = 2_000_000) -> DataFrame:
    """urls with host, path, rule and verdict. rules: (host, path, verdict); hosts in lower case.

    The rule of most characters wins, of equal ones that of the longer host; without one the rule is null and
    the verdict is default. Null URLs and those without :// have an empty host and path. Of rules given twice
    the greater verdict by name counts. Where urls has a column of one of the four names, the new one gets underscores.
    Repeated rows have equal results, an empty table gives none. The digests are written once and sent to every machine
    as a file; beyond most_rules rules they are joined instead.
    """
    names = [free_name(urls.columns, c) for c in ("host", "path", "rule", "verdict")]
    u = urls.select(F.struct("*").alias("row"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    judged = _judge_by_join(u, rules, default) if rules.count() > most_rules else _judge_by_index(u, rules, default)
    return judged.select("row.*", *[F.col(c).alias(n) for c, n in zip(("host", "path", "rule", "verdict"), names, strict=True)])


def _judge_by_index(u: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    rows = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]  # most_rules at most
    # one file in the shared folder, which Spark brings to each machine once
    spark = u.sparkSession
    path = new_path(spark, "digests")
    written(spark, path, DigestIndex.packed(rows))
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]
    longest = max((len(r[0]) for r in rows), default=0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        for b in batches:
            strings, owners, ranks = [], [], []
            for i, (h, p) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                for s in suffixes(h, longest):
                    for n in index.lengths:
                        if n <= len(p):
                            strings.append(s + p[:n])
                            owners.append(i)
                            ranks.append((len(s) + n, len(s)))
            rule, verdict, best = [None] * b.num_rows, [default] * b.num_rows, [(-1, -1)] * b.num_rows
            for i, rank, s, k in zip(owners, ranks, strings, index.probe(strings).tolist(), strict=True):
                if k >= 0 and rank > best[i]:
                    best[i], rule[i], verdict[i] = rank, s, index.names[index.verdict[k]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*b.schema.names, "rule", "verdict"])

    schema = u.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}).schema
    return u.mapInArrow(look_up, schema)


def _judge_by_join(u: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a shuffle on (host suffix, path length, path start), for more rules than a worker should hold."""
    r = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv"))
    lengths = sorted(x["n"] for x in r.select(F.char_length("rp").alias("n")).distinct().collect())
    longest = r.agg(F.max(F.char_length("rh"))).first()[0]
    u = u.withColumn("__id", F.monotonically_increasing_id())
    # of a longer host what stands behind the first dot of its end
    end = F.right("host", F.lit(longest + 1))
    labels = F.when(F.char_length("host") <= longest, F.split("host", r"\.")).when(F.contains(end, F.lit(".")), F.split(F.substr(end, F.instr(end, ".") + 1), r"\.")).otherwise(F.array().cast("array<string>"))
    hosts = F.transform(F.when(F.size(labels) > 0, F.sequence(F.lit(1), F.size(labels))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    c = u.select("__id", "path", F.explode(hosts).alias("rh")).select("__id", "rh", F.explode(F.array(*[F.when(F.char_length("path") >= n, F.left("path", F.lit(n))) for n in lengths])).alias("rp"))
    hit = c.join(r, ["rh", "rp"]).groupBy("__id").agg(F.max(F.struct((F.char_length("rh") + F.char_length("rp")).alias("n"), F.char_length("rh").alias("m"), F.concat("rh", "rp").alias("rule"), "rv")).alias("b"))
    return u.join(hit, "__id", "left").withColumns({"rule": F.col("b.rule"), "verdict": F.coalesce("b.rv", F.lit(default))}).drop("__id", "b")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with p as (
  select page_id,
         case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r (rhost, rpath, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(v, length(rhost || rpath)) as v
  from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from h left join m using (page_id)
"""
