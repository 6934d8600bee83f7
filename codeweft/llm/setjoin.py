"""All similar pairs between set-valued records, by a sorted sketch forest.

Each distinct set gets minhash signatures in many independent trees; a tree is the list of all signatures in lexicographic
order. Records with a common prefix of at least the base depth are neighbours and lie next to each other; the base depth is the
deepest at which the trees still reach the target recall at the threshold. One pass over the sorted rows compares
neighbourhoods; one of more than MAX_NEIGHBOURS records is left for the longer prefixes inside it, one hash deeper at a time.
At full depth the rest is compared whole, in blocks. A record for which deepening costs so much that its
recall would fall under the target is compared exactly, by its rarest elements, against all. Every candidate is verified on
the exact sets.

Records with equal sets form a class and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import fragment_join
from codeweft.session import small, staged

TREES, TARGET_RECALL, EXTRA_LEVELS, MAX_NEIGHBOURS = 40, 0.9999, 3, 256


def base_depth(threshold: float, trees: int = TREES, recall: float = TARGET_RECALL) -> int:
    """The deepest prefix at which a pair at the threshold still meets in some tree with the target recall."""
    d = 1
    while 1 - (1 - threshold ** (d + 1)) ** trees >= recall:
        d += 1
    return d


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _signer(trees: int, depth: int, seed: int):
    seeds = np.random.default_rng(seed).integers(0, 2**63, size=(trees, depth + EXTRA_LEVELS), dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = batch.column("set")
            values = sets.flatten().to_numpy().view(np.uint64)
            starts = sets.offsets.to_numpy()[:-1] - sets.offsets[0].as_py()
            size = np.minimum(np.diff(sets.offsets.to_numpy()), 0xFFFF).astype(np.uint64)
            cls = batch.column("cls").to_numpy()
            keys, deeps = [], []
            with np.errstate(over="ignore"):
                for t in range(trees):
                    key, deep = np.full(len(starts), seeds[t, 0]), size.copy()
                    for j in range(depth + EXTRA_LEVELS):
                        low = np.minimum.reduceat(_mix(values ^ seeds[t, j]), starts)
                        if j < depth:
                            key = _mix(key * np.uint64(31) + low)
                        else:
                            deep |= (low & np.uint64(0xFFFF)) << np.uint64(16 * (EXTRA_LEVELS - (j - depth)))
                    keys.append(key.view(np.int64))
                    deeps.append(deep.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(deeps)), pa.array(np.tile(cls, trees))], names=["key", "deep", "cls"])

    return sign


@dataclass
class SimilarSets:
    """members: (id, side, cls), one row per record. sets: (cls, set, size). pairs: (cls_a, cls_b, overlap, size_a, size_b) of different, similar sets."""

    members: DataFrame
    sets: DataFrame
    pairs: DataFrame


def record_sets(df: DataFrame, id_col: str, values: str, side: int, min_size: int) -> DataFrame:
    """(id, side, set): the distinct non-null values of all rows of an id, as sorted 64-bit hashes; smaller sets are left out."""
    hashed = F.array_distinct(F.transform(F.array_compact(F.coalesce(F.col(values).cast("array<string>"), F.array().cast("array<string>"))), lambda x: F.xxhash64(x)))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_sort(hashed).alias("h")).where(F.size("h") > 0)
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("h")))).alias("set")).where(F.size("set") >= min_size).select("id", F.lit(side).alias("side"), "set")


def _unordered(key: DataFrame) -> DataFrame:
    return key.where(F.col("cls_a") != F.col("cls_b")).select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b"))


def _near(threshold: float):
    """Sizes (the low 16 bits of deep, clipped) that can still meet the threshold."""

    def ok(a, b):
        x, y = a.bitwiseAND(F.lit(0xFFFF)), b.bitwiseAND(F.lit(0xFFFF))
        return (F.greatest(x, y) == 0xFFFF) | (F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9)

    return ok


PAIR, RESOLVED, CROWD = 0, 1, 2
FOUND = "kind int, a long, b long, c long"


class Tree:
    """The pass over rows sorted by (key, deep): pairs inside neighbourhoods, with no more than one of them held at a time.

    Gives rows (kind, a, b, c): PAIR of classes a and b; RESOLVED for class a, compared at b levels below the base depth; CROWD for
    class b with deep c in a neighbourhood a that is too large at full depth.
    """

    def __init__(self, threshold: float, most: int = MAX_NEIGHBOURS) -> None:
        self.threshold, self.most = threshold, most
        self.rows = tuple(np.empty(0, np.int64) for _ in range(3))
        self.large = 0  # levels at which the neighbourhood of the last row is known to be too large

    def feed(self, key: np.ndarray, deep: np.ndarray, cls: np.ndarray, last: bool = False) -> list[np.ndarray]:
        self.key, self.deep, self.cls = (np.concatenate(x) for x in zip(self.rows, (key, deep, cls)))
        n, self.out, self.small, self.keep, large = len(self.key), [], [], None, self.large
        if not n:
            return []
        # neighbourhoods at the base depth; only the first, the last and the large ones need a closer look
        starts = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1])))
        ends = np.append(starts[1:], n)
        size = ends - starts
        plain = size <= self.most
        plain[-1] &= last
        if large and self.mark_key == self.key[0]:
            plain[0] = False
        self.large = 0
        self._compare(starts[plain], ends[plain], 0)
        for i in np.flatnonzero(~plain):
            same = large if i == 0 and large and self.mark_key == self.key[0] else 0
            self._deepen(starts[i], ends[i], 0, i == len(starts) - 1 and not last, same)
        if self.keep is None:
            self.keep = n
        self.mark_key, self.mark_deep = self.key[-1], self.deep[-1]
        self.rows = (self.key[self.keep :], self.deep[self.keep :], self.cls[self.keep :])
        return self.out

    def _deepen(self, lo: int, hi: int, level: int, going_on: bool, same: int) -> None:
        """Rows lo to hi share their prefix down to level; going_on: more may follow. same: levels known to be large from earlier rows."""
        if hi - lo <= self.most and not same:
            if going_on:
                self.keep = lo
            else:
                self._compare(np.array([lo]), np.array([hi]), level)
            return
        if going_on:
            self.large = level + 1
        if level == EXTRA_LEVELS:
            crowd = _hashed(self.key[lo:hi], self.deep[lo:hi])
            self.out.append(np.stack([np.full(hi - lo, CROWD), crowd, self.cls[lo:hi], self.deep[lo:hi]]))
            self.out.append(np.stack([np.full(hi - lo, RESOLVED), self.cls[lo:hi], np.full(hi - lo, level), np.zeros(hi - lo, np.int64)]))
            return
        part = self.deep[lo:hi] >> (16 * (EXTRA_LEVELS - level))
        cuts = lo + np.flatnonzero(part[1:] != part[:-1]) + 1
        starts, ends = np.concatenate(([lo], cuts)), np.append(cuts, hi)
        follows = same > level + 1 and (self.mark_deep >> (16 * (EXTRA_LEVELS - level))) == part[0]
        plain = ends - starts <= self.most
        plain[-1] &= not going_on
        plain[0] &= not follows
        self._compare(starts[plain], ends[plain], level + 1)
        for i in np.flatnonzero(~plain):
            self._deepen(starts[i], ends[i], level + 1, going_on and i == len(starts) - 1, same if i == 0 and follows else 0)

    def _compare(self, starts: np.ndarray, ends: np.ndarray, level: int) -> None:
        """All pairs inside neighbourhoods of bounded size whose sizes can meet the threshold."""
        length = ends - starts
        if level:
            at = np.repeat(starts, length) + _counted(length)
            self.out.append(np.stack([np.full(len(at), RESOLVED), self.cls[at], np.full(len(at), level), np.zeros(len(at), np.int64)]))
        starts, ends = starts[length > 1], ends[length > 1]
        at, room = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        at = at + _counted(ends - starts)
        size = self.deep & 0xFFFF
        step = 1
        while len(at):
            fits = at + step < room
            at, room = at[fits], room[fits]
            i, j = at, at + step
            x, y = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = ((y == 0xFFFF) | (x >= y * self.threshold - 1e-9)) & (self.cls[i] != self.cls[j])
            a, b = self.cls[i[ok]], self.cls[j[ok]]
            if len(a):
                self.out.append(np.stack([np.full(len(a), PAIR), np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)]))
            step += 1


def _counted(length: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each length, one after the other."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def _hashed(key: np.ndarray, deep: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(key.view(np.uint64) * np.uint64(31) + (deep.view(np.uint64) >> np.uint64(16))).view(np.int64)


def _pass(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(threshold)
        none = np.empty(0, np.int64)

        def rows(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if out:
                k, a, b, c = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

        for batch in batches:
            yield from rows(tree.feed(*(batch.column(c).to_numpy() for c in ("key", "deep", "cls"))))
        yield from rows(tree.feed(none, none, none, last=True))

    return run


def _blocked(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs inside neighbourhoods of any size, each pair of blocks on its own."""
    near = _near(threshold)
    b = rows.withColumn("blocks", F.ceil(F.col("n") / MAX_NEIGHBOURS).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    left = b.select("key", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.col("cls").alias("cls_a"), F.col("deep").alias("deep_a"))
    right = b.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("cls").alias("cls_b"), F.col("deep").alias("deep_b"))
    return _unordered(left.join(right, ["key", "i", "j"]).where(near(F.col("deep_a"), F.col("deep_b"))))


def _by_rarest(sets: DataFrame, few: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates of few classes against all: sets that are similar enough share one of their rarest elements.

    Elements that very many sets hold are split over tasks.
    """
    items = sets.select("cls", "size", F.explode("set").alias("x"))
    seen = items.groupBy("x").agg(F.count(F.lit(1)).alias("f"))
    ranked = fragment_join(items, seen, "x", "inner").groupBy("cls", "size").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("r"))
    keep = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    rare = staged(ranked.select("cls", "size", F.explode(F.slice("r", F.lit(1), keep)).alias("r")).select("cls", "size", F.col("r.x").alias("x")))
    a = rare.join(few, "cls", "left_semi").select("x", F.col("cls").alias("cls_a"), F.col("size").alias("size_a"))
    b = rare.select("x", F.col("cls").alias("cls_b"), F.col("size").alias("size_b"))
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9
    return _unordered(fragment_join(b, a, "x", "inner").where(fits))


def similar_sets(records: DataFrame, threshold: float, trees: int = TREES, recall: float = TARGET_RECALL, seed: int = 42) -> SimilarSets:
    """Similar pairs among records (id, side, set); sets as made by record_sets.

    Similarity is overlap / union of the distinct elements. Equal sets, ties and repeated rows fall into one class, which has
    no pair with itself. Empty input gives empty frames.
    """
    depth = base_depth(threshold, trees, recall)
    records = staged(records.withColumn("cls", F.xxhash64("set")))
    sets = staged(records.groupBy("cls", "set").agg(F.size("set").alias("size")).select("cls", "set", "size"))
    signed = sets.select("cls", "set").mapInArrow(_signer(trees, depth, seed), "key long, deep long, cls long")
    # a neighbourhood lies in one partition, in order
    found = staged(signed.repartition("key").sortWithinPartitions("key", "deep").mapInArrow(_pass(threshold), FOUND))
    candidates = found.where(F.col("kind") == PAIR).select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"))
    crowd = found.where(F.col("kind") == CROWD)
    if not crowd.isEmpty():
        n = crowd.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        rows = crowd.join(small(n), "a").select(F.col("a").alias("key"), F.col("b").alias("cls"), F.col("c").alias("deep"), "n")
        candidates = candidates.unionByName(_blocked(rows, threshold))
    # every level costs a tree's share of the recall
    losses = F.element_at(F.array(*(F.lit(sum(_loss(threshold, depth + i) for i in range(level + 1))) for level in range(EXTRA_LEVELS))), F.col("b").cast("int"))
    spare = math.log(1 - recall) - trees * math.log(1 - threshold**depth)
    few = staged(found.where(F.col("kind") == RESOLVED).groupBy(F.col("a").alias("cls")).agg(F.sum(losses).alias("loss")).where(F.col("loss") > spare).select("cls"))
    if not few.isEmpty():
        candidates = candidates.unionByName(_by_rarest(sets, few, threshold))
    return SimilarSets(records.select("id", "side", "cls"), sets, verified(candidates.distinct(), sets, threshold))


def _loss(threshold: float, depth: int) -> float:
    """What one tree's share of the logarithm of missing a pair at the threshold grows by, one level deeper."""
    return math.log(1 - threshold ** (depth + 1)) - math.log(1 - threshold**depth)


def verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a = sets.select(F.col("cls").alias("cls_a"), F.col("set").alias("set_a"), F.col("size").alias("size_a"))
    b = sets.select(F.col("cls").alias("cls_b"), F.col("set").alias("set_b"), F.col("size").alias("size_b"))
    both = candidates.join(a, "cls_a").join(b, "cls_b").withColumn("overlap", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")) >= threshold).select("cls_a", "cls_b", "overlap", "size_a", "size_b")


def expanded(found: SimilarSets, cross_only_side: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all similar records, members of one class included; pairs with both ends on cross_only_side are left out."""
    m = found.members
    several = m.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    links = found.pairs.select("cls_a", "cls_b").unionByName(several)
    a = m.select(F.col("cls").alias("cls_a"), F.col("id").alias("x"), F.col("side").alias("sx"))
    b = m.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"), F.col("side").alias("sy"))
    pairs = links.join(a, "cls_a").join(b, "cls_b").where((F.col("cls_a") != F.col("cls_b")) | (F.col("x") < F.col("y"))).where(F.col("x") != F.col("y"))
    if cross_only_side is not None:
        pairs = pairs.where((F.col("sx") != cross_only_side) | (F.col("sy") != cross_only_side))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def link_counts(found: SimilarSets) -> DataFrame:
    """(id, side, cls, links): each record's class and the number of other records similar to it, without expanding classes."""
    size = found.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    both = found.pairs.select(F.explode(F.array(F.struct(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")), F.struct(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))).alias("p")).select("p.*")
    beyond = both.join(size.withColumnRenamed("cls", "other").withColumnRenamed("n", "m"), "other").groupBy("cls").agg(F.sum("m").alias("m"))
    per_class = size.join(beyond, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return found.members.join(per_class, "cls").select("id", "side", "cls", "links")
