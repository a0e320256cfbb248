"""Near duplicates by MinHash: universal hash minima, banding, signature checks, exact checks, components.

Texts with equal shingle sets are one class, which its smallest doc_id stands for. Members of a band bucket whose
signatures may be alike are joined to clusters, and in a cluster links are confirmed on the full shingle sets; their
components, by alternating large-star and small-star, are the result. Buckets and clusters are worked on alike:

1. Each member goes to one block of its group by a hash, and one in BRIDGE to a second block. All pairs of a block are
   compared there, and only a spanning forest of what is alike leaves it. So a group is shuffled about once whatever
   its size, and blocks of a group of copies are joined by the members they share.
2. A group of several blocks that is still in several components has pairs which never met. Its members outside
   of its largest component are compared with all its members. That is few for a group of copies; only a group whose
   members are alike enough to be compared and yet not linked costs the square of its size.

No step writes the pairs of a group out. A link is only left out if no band is shared: at the least similarity 0.75
that has probability (1 - 0.75 ** 4) ** 40, under 3 in 10 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import discarded, fewer, landed, may_be_among, slices

WORDS = 5
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
#: A pair passes the signature check if its estimated similarity is this or more: 6 deviations below 0.75.
ESTIMATE = 0.5
#: Members of one block of a group, about, and bytes of shingle sets in one, about.
BLOCK_MEMBERS = 512
BLOCK_BYTES = 4 << 20
#: One member in so many goes to a second block of its group.
BRIDGE = 16
#: Rows of a block whose estimates are in memory at once.
TILE = 256
#: Distinct words whose hashes a task remembers.
REMEMBERED = 100_000
_rng = np.random.default_rng(20240607)
A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
C = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingle_sets(texts: list, word_hash: _WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text. ASCII letters lower-cased, words between ASCII white space."""
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: ASCII only
        h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
        size = min(len(h), WORDS)
        if not size:
            out.append(h)
            continue
        x = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            x = x * M2 + mixed(h[k : len(h) - size + 1 + k])
        out.append(np.unique(mixed(x + np.uint64(size))))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each non-empty set, each of another universal hash a * x + c."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    v = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, A[k], out=v)
        v += C[k]
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word_hash = _WordHash()
    for b in slices(batches, 64):
        sets = shingle_sets(b.column("text").to_pylist(), word_hash)
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        f = np.zeros((len(n), 2), np.int64)
        bands, bits = [None] * len(n), [None] * len(n)
        if len(full):
            own = [sets[k] for k in full]
            m = minima(own)
            low = mixed(m)  # 2 bits of each minimum
            packed = np.packbits(np.stack([low & np.uint64(1), (low >> np.uint64(1)) & np.uint64(1)], 2).astype(np.uint8).reshape(len(own), -1), axis=1)
            band = np.arange(BANDS, dtype=np.uint64)[None, :] * M1
            for r in range(ROWS):
                band = mixed(band * M2 + m[:, r::ROWS])
            for k, x, y, s in zip(full, band.view(np.int64), packed, own, strict=True):
                bands[k], bits[k], f[k] = x, y.tobytes(), fingerprint(s)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "n", "f1", "f2", "bands", "bits"])


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh128_digest(shingles.tobytes()), np.int64).tolist())


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, bands, bits): size and 128-bit fingerprint of the shingle set, band keys, signature bits."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, "doc_id long, n long, f1 long, f2 long, bands array<long>, bits binary")


def estimated(bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Similarity by signature of all of a with all of b: the share of minima with equal 2 bits, less what chance gives."""
    x = bits_a[:, None, :] ^ bits_b[None, :, :]
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int16)
    return (1 - differ / HASHES - 0.25) / 0.75


def _alike(m: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimates for left x right; 0 where the sizes alone rule the pair out, and for pairs of one component."""
    x, y = m["n"][left][:, None], m["n"][right][None, :]
    e = estimated(m["bits"][left], m["bits"][right])
    e[(100 * np.minimum(x, y) < 75 * np.maximum(x, y)) | (m["comp"][left][:, None] == m["comp"][right][None, :])] = 0
    return e


def candidates(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): the pairs of a block that may be alike, best estimates first. m: n, bits, comp, side; pairs are of sides 0 and 1, or of side 0 alone if that is all."""
    left, right = np.flatnonzero(m["side"] == 0), np.flatnonzero(m["side"] == 1)
    alone = not len(right)
    right = left if alone else right
    xs, ys, es = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for at in range(0, len(left), TILE):
        tile = left[at : at + TILE]
        e = _alike(m, tile, right)
        may = e >= ESTIMATE
        if alone:
            may &= tile[:, None] < right[None, :]
        x, y = np.nonzero(may)
        xs.append(tile[x])
        ys.append(right[y])
        es.append(e[x, y])
    x, y, e = map(np.concatenate, (xs, ys, es))
    order = np.argsort(-e, kind="stable")
    return x[order], y[order]


def joined(m: dict, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """A spanning forest of the block's links, (id, id). linked confirms a pair; pairs already joined are passed over."""
    x, y = candidates(m)
    root = {c: c for c in m["comp"].tolist()}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out, comp, ids = [], m["comp"].tolist(), m["id"]
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        u, v = find(comp[p]), find(comp[q])
        if u != v and linked(p, q):
            root[u] = v
            out.append((int(ids[p]), int(ids[q])))
    return out


def in_bucket(m: dict) -> list[tuple[int, int]]:
    return joined(m, lambda p, q: True)


def in_cluster(m: dict) -> list[tuple[int, int]]:
    """Links confirmed on the full sets."""
    sets = m["set"]

    def linked(p: int, q: int) -> bool:
        common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        return 100 * common >= 75 * (len(sets[p]) + len(sets[q]) - common)

    return joined(m, linked)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (g, i, j) of a sorted partition. Only one run is held."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in ("g", "i", "j")])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            now = tuple(k[:, s].tolist())
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _members(t: pa.Table) -> dict:
    """Arrays by field: of bits a matrix, of sets a list of arrays."""
    m = {c: t.column(c).to_numpy() for c in ("id", "n", "comp", "side")}
    m["bits"] = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    if "set" in t.column_names:
        m["set"] = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    return m


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _compared(rows: DataFrame, work: Callable[[dict], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what work finds in each block (g, i, j) of rows. A partition is sorted and read as a stream, so a task holds one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for block in _blocks(batches):
            found += work(_members(block))
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long")


def one_block_each(members: DataFrame) -> DataFrame:
    """Step 1: members (g, id, nb, ..) with their block as i, a few in two blocks; all of side 0, each a component of its own."""
    block = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("nb")).cast("int")
    bridge = (F.col("nb") > 1) & (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(BRIDGE)) == 0)
    i = F.when(bridge, F.array_distinct(F.array(block(1), block(2)))).otherwise(F.array(block(1)))
    return members.withColumns({"j": F.lit(0), "comp": F.col("id"), "side": F.lit(0)}).withColumn("i", F.explode(i)).drop("nb")


def open_groups(members: DataFrame, components_of: DataFrame) -> DataFrame | None:
    """(g, largest, nr) of the groups of several blocks that are in several components: the largest one, and blocks of the members outside of it.

    members: (g, id, nb); components_of: (id, component). None if there is no such group.
    """
    big = members.filter("nb > 1")
    if not big.limit(1).count():
        return None
    c = components_of.select(F.col("id").alias("c_id"), "component")
    own = big.select("g", "id").join(c, F.col("id") == F.col("c_id"), "left").select("g", F.coalesce("component", "id").alias("comp"))
    per = own.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("k"))
    groups = per.groupBy("g").agg(F.count(F.lit(1)).alias("n_comps"), F.max(F.struct("k", "comp"))["comp"].alias("largest"), (F.sum("k") - F.max("k")).alias("rest"))
    groups = landed(fewer(groups.filter("n_comps > 1").select("g", "largest", n_blocks(F.col("rest")).alias("nr"))), "open-groups")
    return groups if groups.limit(1).count() else None


def across_blocks(members: DataFrame) -> DataFrame:
    """Step 2: for open groups, the members outside of the largest component by all members, each pair of them in one block.

    members: (g, id, nb, nr, comp, largest, ..). Blocks (i, j) with i < nr are those of the outside members: below nr, j
    is a block of theirs too, and only pairs i <= j are made; from nr on, it is one of the largest component's members.
    """
    block = lambda n: F.pmod(F.xxhash64(F.lit(1), "id"), F.col(n)).cast("int")
    upto = lambda a, b: F.when(F.lit(a) <= b if isinstance(a, int) else a <= b, F.sequence(F.lit(a) if isinstance(a, int) else a, b)).otherwise(F.array().cast("array<int>"))
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = block("nr")
    outside = F.concat(
        F.transform(upto(0, F.col("nr") + F.col("nb") - 1), lambda j: F.when(j >= own, cell(own, j, 0))), F.transform(upto(0, own - 1), lambda i: cell(i, own, 1))
    )
    inside = F.transform(upto(0, F.col("nr") - 1), lambda i: cell(i, F.col("nr") + block("nb"), 1))
    at = F.explode(F.array_compact(F.when(F.col("comp") != F.col("largest"), outside).otherwise(inside))).alias("x")
    return members.select(*[x for x in members.columns if x not in ("nb", "nr", "largest")], at).select("*", "x.*").drop("x")


def grouped_links(members: DataFrame, work: Callable[[dict], list[tuple[int, int]]], tag: str, fill: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), their components (id, component)) within the groups of members (g, id, nb, n, bits, ..), a written table; fill adds what work needs besides."""
    links = landed(fewer(_compared(one_block_each(fill(members)), work).distinct()), f"{tag}-links")
    found = landed(fewer(components(links)), f"{tag}-components")
    groups = open_groups(members, found)
    if groups is None:
        return links, found
    c = found.select(F.col("id").alias("c_id"), "component")
    rows = members.join(groups, "g").join(c, F.col("id") == F.col("c_id"), "left").withColumn("comp", F.coalesce("component", "id")).drop("c_id", "component")
    links = landed(fewer(links.unionByName(_compared(across_blocks(fill(landed(rows, "open-members"))), work)).distinct()), f"{tag}-all-links")
    return links, landed(fewer(components(links)), f"{tag}-all-components")


def components(links: DataFrame) -> DataFrame:
    """(id, component): of every id in links (a, b) the smallest id it is joined with, by alternating large-star and small-star.

    Least neighbours are grouped by their sign too, so that both sides of the join with them are dealt anew and Spark
    can split an id that has most of the edges. What a round replaces is deleted.
    """
    edges, old, before = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), [], None
    sign = F.shiftright("u", 63).alias("sign")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u", sign).agg(F.least(F.col("u"), F.min("v")).alias("m")).drop("sign")
        large = landed(fewer(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()), "large-star")
        low = large.groupBy("u", sign).agg(F.min("v").alias("m")).drop("sign")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        seen = Observation()
        edges = landed(fewer(small).observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "small-star")
        discarded(large, *old)
        old, now = [edges], seen.get
        if now == before or not now["n"]:
            # stars by now: what is never a leaf is its component's smallest id
            return edges.select(F.explode(F.array("u", "v")).alias("id"), F.col("v").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
        before = now


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word_hash = _WordHash()
    for b in slices(batches, 256):
        sets = shingle_sets(b.column("text").to_pylist(), word_hash)
        # of a doc_id with several texts the one that is meant
        own = [k for k, (s, f1, f2) in enumerate(zip(sets, b.column("f1").to_pylist(), b.column("f2").to_pylist(), strict=True)) if fingerprint(s) == (f1, f2)]
        kept = b.take(pa.array(own, pa.int64())).drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([sets[k].tobytes() for k in own], pa.binary())], [*kept.schema.names, "set"])


def with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (id, f1, f2, ..), a written table, with set, the hashes of their documents' shingles.

    Documents that no member can be are dropped by a bitmap of the members' ids before texts are shuffled, if they are.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").filter(may_be_among(F.col("doc_id").cast("long"), members, "id"))
    rows = members.join(texts, F.col("id") == F.col("d")).drop("d")
    schema = members.withColumn("set", F.lit(None).cast("binary")).schema
    return rows.mapInArrow(_with_sets, schema)


def n_blocks(n_members: Column, n_bytes: Column | None = None) -> Column:
    """Blocks of a group by its members' number and their sets' bytes."""
    by_members = F.ceil(n_members / BLOCK_MEMBERS)
    return (by_members if n_bytes is None else F.greatest(by_members, F.ceil(n_bytes / BLOCK_BYTES))).cast("int")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    A text of fewer than five words is one shingle; one without words, or null, has none and is linked with
    nothing. Rows of one doc_id are one node, so they have one component whatever their texts. A null doc_id takes no
    part: its component_id is null and it is kept. Repeated rows have equal results, an empty table gives none, and
    columns other than doc_id and text are not looked at.
    """
    sk = landed(sketches(docs), "sketches")
    with_id = sk.filter("n > 0 and doc_id is not null")
    classes = landed(fewer(with_id.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))), "classes")
    reps = with_id.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
    reps = landed(reps.dropDuplicates(["id", "f1", "f2"]), "representatives")
    # band keys alone are shuffled until it is known which of them are shared
    buckets = reps.select(F.explode("bands").alias("g"), "id")
    shared = landed(fewer(buckets.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g", n_blocks(F.col("m")).alias("nb"))), "shared-buckets")
    in_shared = landed(fewer(buckets.join(shared, "g").join(reps.select("id", "n", "bits"), "id").select("g", "id", "nb", "n", "bits"), 2), "bucket-members")
    _, clusters = grouped_links(in_shared, in_bucket, "bucket")
    discarded(in_shared)

    members = reps.join(clusters.select(F.col("id").alias("c"), F.col("component").alias("g")), F.col("id") == F.col("c")).select("g", "id", "n", "bits", "f1", "f2")
    sizes = landed(fewer(members.groupBy("g").agg(n_blocks(F.count(F.lit(1)), F.sum("n") * 8).alias("nb"))), "cluster-sizes")
    members = landed(fewer(members.join(sizes, "g"), 2), "cluster-members")
    links, final = grouped_links(members, in_cluster, "cluster", lambda rows: with_sets(docs, rows))
    # texts of one doc_id are one node: where they are of several classes, these are linked by the id
    several = with_id.groupBy("doc_id").agg(F.count_distinct("f1", "f2").alias("k")).filter("k > 1").select(F.col("doc_id").alias("d"))
    by_id = landed(fewer(with_id.join(several, F.col("doc_id") == F.col("d")).join(classes, ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()), "links-by-id")
    if by_id.limit(1).count():
        final = landed(fewer(components(links.unionByName(by_id))), "components")
    final = final.withColumnRenamed("id", "r")
    known = landed(fewer(classes.join(final, F.col("rep") == F.col("r"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))), "class-components")
    out = sk.join(known, ["f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept; all its columns stay, whatever their names.

    The ids are written first, so that Spark knows their size and sends them to the documents where they are few.
    """
    gone = landed(fewer(near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("d")).distinct()), "not-kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.join(gone, F.col("id") == F.col("d"), "left_anti").select("row.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
