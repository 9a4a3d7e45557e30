"""MinHash near-duplicates: banded candidates, sequential Bayesian verification of signature batches, exact checks, components."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import id_and_text, if_small, map_texts
from sievework.llm.components import components
from sievework.session import cut


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5  # words
    percent: int = 80  # links have 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4  # hashes of a band; a pair at the threshold 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8
    batch: int = 16  # hashes compared at a time
    miss: float = 1e-6  # a pair is pruned if the posterior probability of reaching the threshold falls below this
    block: int = 1024  # members of a group that one step compares with each other; larger groups go in blocks
    block_shingles: int = 4_000_000  # shingles of those members, on average, so that long texts make blocks of fewer members

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes, and their MinHash signature."""

    MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
    KNOWN = 500_000  # words whose hash is kept

    def __init__(self, config: NearConfig):
        self.config = config
        rng = np.random.default_rng(20240601)
        self.a = (rng.integers(0, 2**31, config.hashes, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, config.hashes, dtype=np.uint64).astype(np.uint32)[:, None]
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> np.ndarray:
        """A-Z in lower case, words between ASCII white space; with fewer words than a shingle has, all of them as one; without words, none."""
        words = text.lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > self.KNOWN:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        k = min(self.config.shingle, len(h))
        n = len(h) - k + 1
        s = np.full(n, k, dtype=np.uint64)
        for i in range(k):  # a polynomial in each step's odd factor, stirred so that the order of the words counts
            s = (s ^ h[i : i + n]) * self.MIX[i % 4]
            s ^= s >> np.uint64(29)
        s *= self.MIX[1]
        s ^= s >> np.uint64(32)
        return np.unique(s)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(16)).astype(np.uint32)
        out = np.full(self.config.hashes, 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(out, (self.a * x[None, at : at + 2048] + self.b).min(axis=1), out=out)
        return out


class Verifier:
    """Which pairs are links: signature batches prune, full sets decide."""

    HELD = 16_000_000  # hashes of the full sets that are kept

    def __init__(self, config: NearConfig):
        self.config = config
        self.shingler = Shingler(config)
        self.unpack = zstandard.ZstdDecompressor()
        self.sets: OrderedDict = OrderedDict()
        self.held = 0
        steps = range(config.batch, config.hashes + 1, config.batch)
        self.least = [least_matches(n, config.percent / 100, config.miss) for n in steps]

    def survivors(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Indexes of the rows of many that no batch prunes against one, the most alike first."""
        alive = np.arange(len(many))
        matches = np.zeros(len(many), dtype=np.int32)
        for k, least in enumerate(self.least):
            cols = slice(k * self.config.batch, (k + 1) * self.config.batch)
            matches = matches + (many[alive, cols] == one[cols]).sum(axis=1)
            stay = matches >= least
            alive, matches = alive[stay], matches[stay]
            if not len(alive):
                break
        return alive[np.argsort(-matches, kind="stable")]

    def full_set(self, key, packed: bytes) -> np.ndarray:
        s = self.sets.get(key)
        if s is None:
            s = self.sets[key] = self.shingler.shingles(self.unpack.decompress(packed))
            self.held += len(s)
            while self.held > self.HELD and len(self.sets) > 2:
                self.held -= len(self.sets.popitem(last=False)[1])
        else:
            self.sets.move_to_end(key)
        return s

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        p = self.config.percent
        if not len(a) or not len(b) or 100 * min(len(a), len(b)) < p * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= p * (len(a) + len(b) - both)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of n hashes for which P(similarity >= threshold), under a uniform prior, is not below miss.

    The posterior is Beta(m + 1, n - m + 1); its upper tail at the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


class Union:
    """Sets of merged keys."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (u := self.up.get(root, root)) != root:
            root = u
        while (u := self.up.get(x, x)) != root:
            self.up[x] = root
            x = u
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def with_row(docs: DataFrame) -> DataFrame:
    """docs with doc_id as a struct (doc_id, t); t, a hash of the text, tells rows of one doc_id apart."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text")


def sketch(docs: DataFrame, config: NearConfig) -> DataFrame:
    """doc_id, t, n_shingles, k1, k2 (128 bits of the set), sig (empty without shingles)."""

    def make():
        shingler = Shingler(config)

        def f(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_shingles": [], "k1": [], "k2": [], "sig": []}
            for t in texts:
                s = shingler.shingles(t.encode("utf-8", "replace"))
                d = xxhash.xxh3_128_digest(s.tobytes())
                out["n_shingles"].append(len(s))
                out["k1"].append(int.from_bytes(d[:8], "little", signed=True))
                out["k2"].append(int.from_bytes(d[8:], "little", signed=True))
                out["sig"].append(shingler.signature(s).tobytes() if len(s) else b"")
            return out

        return f

    return map_texts(with_row(docs), make, [("n_shingles", "bigint"), ("k1", "bigint"), ("k2", "bigint"), ("sig", "binary")]).select("doc_id.*", "n_shingles", "k1", "k2", "sig")


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, t, packed: the text under zstandard, so that what is shuffled stays small."""

    def make():
        z = zstandard.ZstdCompressor(level=3)
        return lambda texts: {"packed": [z.compress(t.encode("utf-8", "replace")) for t in texts]}

    return map_texts(with_row(docs), make, [("packed", "binary")]).select("doc_id.*", "packed")


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, sig, packed of the nodes (id, doc, t, sig): one text of each. Few nodes are broadcast, so that no other text moves; else texts move packed."""
    keys = nodes.select("id", F.col("doc").alias("__doc"), F.col("t").alias("__t"))
    side = if_small(keys)
    few = side is not keys
    wanted = docs.join(side, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__t")), "left_semi") if few else docs
    packed = packed_texts(wanted).select(F.col("doc_id").alias("doc"), "t", "packed")
    return packed.join(nodes, ["doc", "t"]).select("id", "sig", "packed").dropDuplicates(["id"])


def in_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The rows of sorted batches group by group, as columns."""
    held: dict[str, list] = {}
    for b in batches:
        cols = b.to_pydict()
        ks = cols[key]
        at = 0
        while at < len(ks):
            end = at + 1
            while end < len(ks) and ks[end] == ks[at]:
                end += 1
            if held and held[key][0] != ks[at]:
                yield held
                held = {}
            for n, v in cols.items():
                held.setdefault(n, []).extend(v[at:end])
            at = end
    if held:
        yield held


def links_in_blocks(rows: DataFrame, payload: DataFrame, config: NearConfig) -> DataFrame:
    """Links (a, b) that join the rows' components, from rows (g, id, side, comp).

    Rows of one g meet in one task, at most some blocks of them. Side 0 meets side 0 and 1; side 1 only side 0. Pairs of one
    component, by comp or by links found before, need no check, so a group gives fewer links than it has rows.
    """
    full = rows.join(payload, "id").select("g", "side", "id", "comp", "sig", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Verifier(config)
        for grp in in_groups(batches, "g"):
            ids, comps, packed = grp["id"], grp["comp"], grp["packed"]
            first = sum(s == 0 for s in grp["side"])
            sigs = np.frombuffer(b"".join(grp["sig"]), dtype=np.uint32).reshape(len(ids), -1)
            union, found = Union(), []
            for i in range(first):
                apart = np.array([j for j in range(i + 1, len(ids)) if union.find(comps[j]) != union.find(comps[i])], dtype=np.int64)
                if not len(apart):
                    continue
                for j in apart[v.survivors(sigs[i], sigs[apart])].tolist():
                    if union.find(comps[i]) != union.find(comps[j]) and v.linked(v.full_set(ids[i], packed[i]), v.full_set(ids[j], packed[j])):
                        union.join(comps[i], comps[j])
                        found.append((ids[i], ids[j]))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]})

    near = full.repartition("g").sortWithinPartitions("g", "side", "id")
    return near.mapInArrow(run, "a long, b long")


def same_document(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes that the rows of one doc_id with different sets belong to."""
    some = base.where("n_shingles > 0 and doc_id is not null")
    key = F.struct("k1", "k2")
    twins = cut(some.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id", "lo"))
    pairs = some.join(if_small(twins), "doc_id").where(key != F.col("lo")).select("k1", "k2", "lo").distinct()
    ids = nodes.select("k1", "k2", "id")
    return pairs.join(ids.withColumnRenamed("id", "a"), ["k1", "k2"]).select("a", F.col("lo.k1").alias("k1"), F.col("lo.k2").alias("k2")).join(ids.withColumnRenamed("id", "b"), ["k1", "k2"]).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: NearConfig | None = None) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Rows with equal shingle sets are one node; other links are found so: nodes that share a band form a group with the smallest
    of them, all pairs of a group that are not connected yet are compared batch by batch, and survivors are checked on their
    full sets. Groups beyond config.block nodes, or beyond config.block_shingles shingles, are dealt to blocks, each with the
    group's smallest node; nodes that stay outside the group's largest component then meet all its blocks.

    Null and empty texts, and ones without words, have no shingles and link with nothing. Texts of any length are shingled whole;
    a task holds a block's texts packed, and a bounded number of their sets. Rows with one doc_id are linked with each other, whatever their
    texts, if these have words; ties by similarity don't matter, as a link is a link. Rows with a null id link with nothing and are
    kept. Ids may be of any type that has an order. An empty table gives no rows; other columns of df, whatever their names, play no part.
    """
    config = config or NearConfig()
    docs = id_and_text(df, id_col, text_col)
    base = cut(sketch(docs, config))
    least = F.min(F.struct("doc_id", "t", "n_shingles", "sig")).alias("m")
    # the numbers are written with the nodes: they stay as they are from here on
    nodes = cut(base.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(least).select(F.monotonically_increasing_id().alias("id"), "k1", "k2", F.col("m.doc_id").alias("doc"), "m.t", "m.n_shingles", "m.sig"))
    width = 4 * config.rows
    keys = F.array(*(F.xxhash64(F.lit(j), F.substring("sig", j * width + 1, width)) for j in range(config.bands)))
    banded = nodes.select("id", "n_shingles", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").select("key", "center")
    members = cut(banded.join(shared, "key").select("center", "id", "n_shingles").distinct())
    sizes = members.groupBy("center").agg(F.ceil(F.greatest(F.count("*") / config.block, F.sum("n_shingles") / config.block_shingles)).cast("long").alias("blocks"), F.count("*").alias("n"))
    sized = members.join(sizes.withColumn("blocks", F.least("blocks", "n")), "center")
    blocks = F.col("blocks")
    block = F.when(F.col("id") == F.col("center"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), blocks)))
    rows = sized.select("center", "id", F.explode(block).alias("block")).select(F.xxhash64("center", "block").alias("g"), F.lit(0).alias("side"), "id", F.col("id").alias("comp"))
    payload = cut(texts_of(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc", "t", "sig"), docs))
    links = cut(links_in_blocks(rows, payload, config).unionAll(same_document(base, nodes)))
    found = components(links)
    large = sized.where(F.col("blocks") > 1)
    if not large.isEmpty():
        links = links.unionAll(rest_of_large_groups(large, found, payload, config))
        found = components(links)
    found = cut(found)
    linked = found.unionAll(found.select("component", "component").distinct()).toDF("id", "component")
    firsts = linked.join(nodes.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("first"))
    names = linked.join(firsts, "component").select("id", "first")
    named = base.join(nodes.select("k1", "k2", "id", "doc").join(names, "id", "left"), ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("first", "doc")).otherwise(F.col("doc_id"))
    return named.select("doc_id", base["n_shingles"], component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def rest_of_large_groups(large: DataFrame, found: DataFrame, payload: DataFrame, config: NearConfig) -> DataFrame:
    """Links between a large group's nodes outside its largest component and all its nodes, block against block."""
    labelled = cut(large.join(found, F.col("id") == F.col("node"), "left").select("center", "id", "blocks", F.coalesce("component", "id").alias("comp")))
    counts = labelled.groupBy("center", "comp").agg(F.count("*").alias("m"))
    top = counts.groupBy("center").agg(F.max(F.struct("m", "comp")).alias("t"), F.sum("m").alias("all")).where(F.col("all") > F.col("t.m")).select("center", F.col("t.comp").alias("top"), ((F.col("all") - F.col("t.m")) / F.col("all")).alias("outside"))
    both = labelled.join(top, "center")
    ublocks = F.ceil(2 * F.col("blocks") * F.col("outside")).cast("long")
    mblocks = F.col("blocks")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    outer = both.where("comp <> top").select("center", "id", "comp", F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), ublocks).alias("u"), F.explode(spread(mblocks)).alias("m"))
    inner = both.select("center", "id", "comp", F.lit(1).alias("side"), F.explode(spread(ublocks)).alias("u"), F.pmod(F.xxhash64(F.lit(1), "id"), mblocks).alias("m"))
    rows = outer.unionAll(inner).select(F.xxhash64("center", "u", "m").alias("g"), "side", "id", "comp")
    return cut(links_in_blocks(rows, payload, config))


def links_oracle(shingle: int) -> str:
    """DuckDB SQL: all pairs with a common shingle, their exact similarity, and reachability."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {shingle} - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {shingle - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
sets AS (SELECT doc_id, list_sort(list(s)) AS whole, count(*) AS n FROM sh GROUP BY doc_id),
named AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS node FROM sets),
reps AS (SELECT sh.* FROM sh JOIN named USING (doc_id) WHERE node = doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN named x ON x.doc_id = a JOIN named y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT node AS x, node AS y FROM named UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN named USING (doc_id) LEFT JOIN comp ON comp.x = named.node
"""
