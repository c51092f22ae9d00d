"""Similarity join of n-gram sets over a prefix tree.

Two documents link when the Jaccard similarity of their sets of word n-grams
reaches a threshold, given in hundredths and compared in integers.

1. A pass over all texts counts their n-grams in hashed counters, more of them for
   larger inputs.  Any order of the n-grams gives the right pairs; ordering them by
   these counts, the rare ones first, keeps common passages out of the prefixes below.
2. Documents of equal sets collapse to one class.  A pair that links shares n-grams
   among the first ``n - ceil(t n) + 1`` of either set: of the prefix that ends first,
   all but the few that the pair's sizes let it miss.  Where up to ``PAIRED`` classes
   share an n-gram, their pairs are counted, and pairs that share too few are out.
   Where more do, all are tied to the least of them without a list of pairs (within
   a block of rows before the shuffle), and each class's number of such n-grams counts
   in favour of its pairs.  What hangs together forms a cluster.
3. The texts of each cluster meet once.  Their sets, in the same order from its
   other end, so that copies share long paths, go into a path-compressed trie.  Each
   set traverses it; the overlap of a shared path is computed once for all sets
   below, a subtree is cut when the sizes that remain cannot reach the threshold,
   and also when all of it already belongs to the set's own component, so a group of
   near copies costs one comparison for each and not one for every pair.
4. A cluster of more than ``GROUP_TOKENS`` n-grams is cut into bands by set size, so
   that only sets of one band or of neighbours can link, and bands into blocks.  The
   first block of each band meets every other that can link with it; pairs of blocks
   that are then known to be one component are done, and only the rest meet too.
   Distributed connected components join the links.

Every link found is exact up to the 58 bits that are kept of an n-gram's hash.

Words are maximal runs of bytes other than the ASCII white space, with A-Z
lowered.  A text with fewer words than ``n`` has its whole sequence as its one
n-gram; one without words, or null, has an empty set and links with nothing.
Repeated rows and copies share a class.  A document with a null id links as any other,
but gives no component its name: one of such documents only has none (null).  Rows
that share an id are documents of their own.  Empty tables give no rows.  Columns
other than the two named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, shuffle_width, table, written
from .components import components

#: Counters: a power of two between these, about one for each ``BYTES_PER_COUNTER`` of the stored input.
COUNTER_BITS, BYTES_PER_COUNTER = (18, 24), 64
SLICE_BITS = 16
#: Classes that may share an n-gram for their pairs to be counted; beyond it they are tied to the least of them.
PAIRED = 16
#: N-grams of one trie, and prefix n-grams of one block of rows.
GROUP_TOKENS, BLOCK_TOKENS = 3_000_000, 2_000_000
CACHE_WORDS = 250_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * _MULTIPLIERS[j % len(_MULTIPLIERS)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys whose ascending order is the global one: count class first, then hash."""
    bits = len(classes).bit_length() - 1
    return np.sort((classes[hashes >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6)))


def prefix_length(size: int, percent: int) -> int:
    return size - (percent * size + 99) // 100 + 1 if size else 0


# ---------------------------------------------------------------- the order

COUNTS = T.StructType([T.StructField("part", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def _sum_counts(by: int | None):
    """Adds up the arrays of a group; the groups of one step are bounded by ``by``.  The last step gives classes."""

    def add(key, frame):
        import pandas as pd

        total = np.zeros(1 << SLICE_BITS, np.int64)
        for raw in frame["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.int64)
        if not by:  # four classes to a doubling of the count
            total = np.minimum(np.log2(np.maximum(total, 1)) * 4, 63).astype(np.uint8)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) % by if by else 0], "slice": [int(frame["slice"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    return add


def counter_bits(texts: DataFrame) -> int:
    """By the size that Spark knows of the input; it decides how well n-grams are ordered, never what is found."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max((size // BYTES_PER_COUNTER).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])


def count_classes(texts: DataFrame, n: int) -> np.ndarray:
    """The class of each counter: four to a doubling of its count, over all rows."""
    bits = counter_bits(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)

        def add(held: list[np.ndarray]) -> None:
            at, k = np.unique(np.concatenate(held), return_counts=True)
            total[at] += k

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                h = (shingles(text, n) >> np.uint64(64 - bits)).astype(np.int32)
                held.append(h)
                size += len(h)
                if size > BLOCK_TOKENS:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        part, schema = TaskContext.get().partitionId(), to_arrow_schema(COUNTS)
        for k, counts in enumerate(total.reshape(-1, 1 << SLICE_BITS)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], schema=schema)
        del total
        release(_WORDS.clear)

    counted = texts.select("text").mapInArrow(count, COUNTS)
    some = counted.groupBy("slice", F.pmod("part", F.lit(256))).applyInPandas(_sum_counts(256), COUNTS)
    rows = some.groupBy("slice").applyInPandas(_sum_counts(None), COUNTS).collect()  # an array of bounded size in slices
    classes = np.zeros((1 << bits >> SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    for r in rows:
        classes[r["slice"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint8)
    return classes.ravel()


# ---------------------------------------------------------------- candidates

SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("node", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("prefix", T.BinaryType()),
    ]
)


def _sets(texts: DataFrame, n: int, percent: int, classes: Broadcast) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SETS)
        for b in batches:
            out = []
            for doc, text, key in zip(*(c.to_pylist() for c in b.columns)):
                keys = ordered(shingles(text, n), classes.value)
                digest = xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None
                node = int.from_bytes(digest[:8], "big", signed=True) if digest else None
                prefix = keys[: prefix_length(len(keys), percent)]
                last = int(prefix[-1]) - (1 << 63) if len(prefix) else None  # signed numbers in the order of the keys
                out.append((doc, len(keys), digest, node, key, last, prefix.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release(_WORDS.clear)

    return texts.select("doc_id", "text", "key").mapInArrow(make, SETS)


def _meetings(sets: DataFrame, ties: bool) -> DataFrame:
    """Per block of rows: n-grams with the classes that have them, or (ties) the classes of crowded n-grams with the least.

    An n-gram that more than ``PAIRED`` classes of the block have goes on with its least class only, and how many it stands for.
    """
    names = ("a", "b") if ties else ("key", "a", "n")
    out = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)

        def block(nodes: list[int], prefixes: list[bytes]) -> Iterator[pa.RecordBatch]:
            keys = np.frombuffer(b"".join(prefixes), np.int64)
            owner = np.repeat(np.array(nodes, np.int64), [len(p) // 8 for p in prefixes])
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[first, len(keys)])
            crowded = np.repeat(sizes > PAIRED, sizes)
            lead = np.repeat(owner[first], sizes)
            if ties:
                columns = (lead[crowded], owner[crowded])
            else:
                sole = ~crowded
                sole[first] = True
                columns = (keys[sole], owner[sole], np.where(crowded, np.repeat(sizes, sizes), 1)[sole])
            for k in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000], pa.int64()) for c in columns], schema=schema)

        held: dict[int, bytes] = {}
        size = 0
        for b in batches:
            for node, prefix in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node not in held:
                    held[node] = prefix
                    size += len(prefix) // 8
                if size > BLOCK_TOKENS:
                    yield from block(list(held), list(held.values()))
                    held, size = {}, 0
        if held:
            yield from block(list(held), list(held.values()))
        del held
        release()

    return sets.filter("n_shingles > 0").select("node", "prefix").mapInArrow(meet, out)


def _clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(node, cluster): classes that may link, directly or through others."""
    # Blocks report a common key each, so its rows are summed in part before they meet, and meet their sum in a join that AQE can split.
    met = written(_meetings(sets, False), "jaccard-met")
    sums = written(met.groupBy("key").agg(F.sum("n").alias("total"), F.min("a").alias("lead")).filter("total > 1"), "jaccard-sums")
    keyed = written(met.join(sums, "key"), "jaccard-shared")
    inside = written(_meetings(sets, True), "jaccard-crowded")
    crowded = keyed.filter(F.col("total") > PAIRED)
    ties = inside.unionByName(crowded.select(F.col("lead").alias("a"), F.col("a").alias("b")))
    # A class alone in its block's row was not counted there.
    often = inside.select("b").unionByName(crowded.filter("n = 1").select(F.col("a").alias("b"))).groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("often"))

    few = keyed.filter(F.col("total") <= PAIRED).groupBy("key").agg(F.array_sort(F.collect_set("a")).alias("m")).filter("size(m) > 1")
    pairs = few.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: y > F.col("x"))).alias("y"))
    shared = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    facts = sets.filter("n_shingles > 0").groupBy("node", "n_shingles", "last").agg(F.count(F.lit(1)).alias("_")).drop("_")
    facts = written(facts.join(often, "node", "left").withColumn("often", F.coalesce("often", F.lit(0))), "jaccard-facts")
    of = lambda s: facts.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("last").alias(f"last{s}"), F.col("often").alias(f"often{s}"))
    known = shared.join(of("x"), "x").join(of("y"), "y")
    overlap = F.expr(f"({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    prefix = lambda n: F.expr(f"{n} - (({percent} * {n} + 99) div 100) + 1")
    need = F.when(F.col("lasty") <= F.col("lastx"), prefix("ny") - F.col("ny") + overlap).otherwise(prefix("nx") - F.col("nx") + overlap)
    sized = F.expr(f"{percent} * greatest(nx, ny) <= 100 * least(nx, ny)")
    likely = known.filter(sized & (F.col("c") + F.least("oftenx", "ofteny") >= need)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(ties.unionByName(likely), "a", "b").select("node", F.col("component").alias("cluster"))


# ---------------------------------------------------------------- the trie


class _Node:
    __slots__ = ("keys", "children", "ends", "least", "most", "owner")

    def __init__(self, keys: np.ndarray):
        self.keys, self.children, self.ends = keys, {}, []
        self.least, self.most, self.owner = 1 << 62, 0, None  # sizes below; a set whose component holds all below (-1: several)


class TrieJoin:
    """Links sets one after another; ``find`` tells components by set number."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, _Node(np.zeros(0, np.uint64))
        self.parent: list[int] = []

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, x: np.ndarray) -> int:
        """Link ``x`` (descending keys, not empty) with what it resembles, then store it."""
        me = len(self.parent)
        self.parent.append(me)
        self._traverse(x, me)
        self._insert(x, me)
        return me

    def _reaches(self, overlap: int, a: int, b: int) -> bool:
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def _traverse(self, x: np.ndarray, me: int) -> None:
        up, n = x[::-1], len(x)
        stack = [(child, 0, 0, 0) for child in self.root.children.values()]
        while stack:
            node, overlap, depth, passed = stack.pop()
            if node.owner is not None and node.owner >= 0 and self.find(node.owner) == self.find(me):
                continue
            keys = node.keys
            at = np.searchsorted(up, keys)  # in ascending order; the path descends
            inside = np.minimum(at, n - 1)
            overlap += int(np.count_nonzero(up[inside] == keys))
            depth += len(keys)
            passed = n - int(at[-1])  # of x, those not below the path's end
            rest = n - passed
            size = min(max(depth + rest, node.least), node.most)
            if not self._reaches(overlap + min(rest, size - depth), n, size):
                continue
            for other in node.ends:
                if self._reaches(overlap, n, depth):
                    a, b = self.find(me), self.find(other)
                    self.parent[max(a, b)] = min(a, b)
            if len(node.children) <= 64:
                stack.extend((child, overlap, depth, passed) for child in node.children.values())
            else:  # the path may only skip so many of x
                stack.extend((c, overlap, depth, passed) for k, c in node.children.items() if self._may_start(x, k, overlap, depth, n, c))

    def _may_start(self, x: np.ndarray, key: int, overlap: int, depth: int, n: int, child: _Node) -> bool:
        rest = int(np.searchsorted(x[::-1], np.uint64(key), side="right"))
        size = min(max(depth + rest, child.least), child.most)
        return self._reaches(overlap + min(rest, size - depth), n, size)

    def _insert(self, x: np.ndarray, me: int) -> None:
        node, at, n = self.root, 0, len(x)
        while True:
            if node is not self.root:
                node.least, node.most = min(node.least, n), max(node.most, n)
                if node.owner is None:
                    node.owner = me
                elif node.owner >= 0 and self.find(node.owner) != self.find(me):
                    node.owner = -1
            if at == n:
                node.ends.append(me)
                return
            child = node.children.get(int(x[at]))
            if child is None:
                child = node.children[int(x[at])] = _Node(x[at:])
                at = n
            else:
                m = min(len(child.keys), n - at)
                differs = np.flatnonzero(child.keys[:m] != x[at : at + m])
                m = int(differs[0]) if len(differs) else m
                if m < len(child.keys):
                    upper = _Node(child.keys[:m])
                    child.keys = child.keys[m:]
                    upper.children[int(child.keys[0])] = child
                    upper.least, upper.most, upper.owner = child.least, child.most, child.owner
                    node.children[int(x[at])] = child = upper
                at += m
            node = child


LINK = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])


def _links(grouped: DataFrame, texts: DataFrame, n: int, percent: int, classes: Broadcast) -> DataFrame:
    """(node, root) for each class that the trie of its group (grp, spot, digest, node) links with others; root is the group's least such node."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(LINK)

        def group(sets: dict[int, np.ndarray]) -> list[tuple]:
            trie, nodes = TrieJoin(percent), list(sets)
            for d in nodes:
                trie.add(sets[d])
            least: dict[int, int] = {}
            roots = [trie.find(k) for k in range(len(nodes))]
            for d, r in zip(nodes, roots):
                least[r] = min(d, least.get(r, d))
            return [(d, least[r]) for d, r in zip(nodes, roots) if d != least[r]]

        now, held, out = None, {}, []
        for b in batches:
            for key, node, digest, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    out += group(held)
                    now, held = key, {}
                if node not in held:
                    keys = ordered(shingles(text, n), classes.value)
                    if xxhash.xxh3_128_digest(keys.tobytes()) == digest:  # a spot may have other texts too
                        held[node] = keys[::-1].copy()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        out = group(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        del held
        release(_WORDS.clear)

    spark = texts.sparkSession
    met = texts.select("spot", "text").join(grouped.hint("shuffle_hash"), "spot")
    dealt = met.repartition(shuffle_width(spark), "grp").sortWithinPartitions("grp")
    return dealt.select("grp", "node", "digest", "text").mapInArrow(join, LINK)


def _stars(links: DataFrame) -> DataFrame:
    """(node, component) of linked classes, the centres too."""
    return components(links, "node", "root")


def _large_links(members: DataFrame, texts: DataFrame, n: int, percent: int, classes: Broadcast, group_tokens: int) -> DataFrame:
    """The links within large clusters (cluster, spot, digest, node, n) by pairs of blocks."""
    # Sizes that can link differ by a factor of 100 / percent at most, so their bands by one.
    band = F.floor(F.log("n") / (1.001 * math.log(100 / percent))).cast("long") if percent < 100 else F.col("n")
    banded = members.withColumn("band", band)
    blocks = F.ceil(F.sum("n") * 2 / group_tokens).cast("int")
    bands = written(banded.groupBy("cluster", "band").agg(blocks.alias("blocks")), "jaccard-bands")
    placed = written(banded.join(bands, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).drop("blocks"), "jaccard-blocks")
    units = bands.select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one = units.select("cluster", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.struct("band", "block").alias("x"))
    pairs = one.join(units.withColumn("y", F.struct("band", "block")).drop("block"), ["cluster", "band"]).filter("x <= y").select("cluster", "x", "y")
    pairs = written(pairs.withColumn("grp", F.xxhash64("cluster", "x", "y")), "jaccard-pairs")

    def meet(chosen: DataFrame) -> DataFrame:
        both = chosen.select("cluster", "grp", F.explode(F.array_distinct(F.array("x", "y"))).alias("unit")).select("cluster", "grp", "unit.band", "unit.block")
        return _links(placed.join(both, ["cluster", "band", "block"]).select("grp", "spot", "digest", "node"), texts, n, percent, classes)

    first = written(meet(pairs.filter("x.block = 0")), "jaccard-links")
    found = written(_stars(first), "jaccard-found")
    one_of = F.coalesce("component", "node")
    state = placed.join(found, "node", "left").groupBy("cluster", F.struct("band", "block").alias("u")).agg(F.min(one_of).alias("least"), F.max(one_of).alias("most"))
    state = written(state, "jaccard-state")
    of = lambda u: state.select("cluster", F.col("u").alias(u), F.col("least").alias(f"least{u}"), F.col("most").alias(f"most{u}"))
    left = pairs.filter("x.block > 0").join(of("x"), ["cluster", "x"]).join(of("y"), ["cluster", "y"])
    left = left.filter("not (leastx = mostx and leasty = mosty and leastx = leasty)")
    return first.unionByName(written(meet(left.select("cluster", "x", "y", "grp")), "jaccard-links"))


def join_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS, groups: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its least linked id).

    With ``groups`` also ``key``, the xxhash64 of its text, which with the id tells documents apart, and ``grp``, which
    names its component whatever the ids (null for an empty set).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    classes = docs.sparkSession.sparkContext.broadcast(count_classes(texts, n))
    sets = written(_sets(texts, n, percent, classes), "jaccard-sets")
    # Where a text can be found again: by its id, or without one by its hash.
    spot = F.coalesce("doc_id", "key")
    texts = texts.withColumn("spot", spot)
    least = [F.min("doc_id").alias("rep"), F.min_by(spot, F.struct(F.col("doc_id").isNull(), spot)).alias("spot")]
    reps = written(sets.filter("n_shingles > 0").groupBy("digest").agg(*least, F.first("n_shingles").alias("n"), F.first("node").alias("node")), "jaccard-classes")
    members = written(reps.join(_clusters(sets, percent), "node").select("digest", "spot", "node", "n", "cluster"), "jaccard-members")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    sizes = written(sizes.select("cluster", (F.col("tokens") > group_tokens).alias("large")), "jaccard-sizes")
    sized = members.join(sizes, "cluster")
    whole = sized.filter("not large").select(F.col("cluster").alias("grp"), "spot", "digest", "node")
    found = written(_links(whole, texts, n, percent, classes), "jaccard-links").select("node", F.col("root").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    if not sizes.filter("large").isEmpty():
        large = written(sized.filter("large").drop("large"), "jaccard-large")
        found = found.unionByName(_stars(_large_links(large, texts, n, percent, classes, group_tokens)))
    linked = written(found.join(reps.select("node", "rep"), "node"), "jaccard-linked")
    names = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = reps.join(linked.join(names, "component").select("node", "least", "component"), "node", "left")
    named = written(named.select("digest", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "node").alias("grp")), "jaccard-components")
    alone = F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id")
    return sets.select("doc_id", "key", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", alone, *(["key", "grp"] if groups else []))


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 4-word shingles at a similarity of 85 hundredths."""
    return join_components(table(spark, sf_dir, "documents"), 4, 85)


SQL: dict[str, str] = {}
QUERIES = {"op7_prefix_tree_join": op7_prefix_tree_join}
