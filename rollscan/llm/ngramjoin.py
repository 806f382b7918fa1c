"""N-gram Jaccard join with count-vector R-trees.

A document's tokens are its distinct word shingles. Documents with equal sets are one class. Tokens hash into groups, and
the counts of a class's tokens in the groups are its point. The overlap of two sets is at most the sum of the minima of
their points' coordinates, so a tree node is passed over when the sum of minima with its upper corner is too small for
the similarity; pairs that survive are verified on the sets themselves.

The trees are built where a link can be: by prefix filtering, two sets of similarity t share one of their first
n - ceil(t n) + 1 tokens in any order that is the same for all. Frequent tokens come last in the order, so that a passage
that many documents share seldom gathers them; where it does, the gathering is split into pairs of blocks. Classes that
the trees join form candidate clusters. Each cluster is first held against its best connected class, in a stream, and
what that leaves is held against all of the cluster in blocks. Nothing is capped: each step only reorders or splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.llm import bloom
from rollscan.llm.common import BROADCAST_ROWS, sized, slices, stage
from rollscan.llm.textnum import U, mix64, shingle_sets

#: Members of a token's gathering, or of a block of it, that one tree holds.
TREE = 1024
LEAF = 16
MOST_FREQUENT = 1 << 20


def groups_for(n: int) -> int:
    """Groups of a set of n tokens: a power of two, about four tokens each. A finer point folds onto a coarser one."""
    return 1 << min(12, max(4, int(n // 4).bit_length()))


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens in their groups. The group is the hash's low bits, so that halves of a point fold together."""
    return np.bincount((tokens & U(groups_for(len(tokens)) - 1)).astype(np.int64), minlength=groups_for(len(tokens))).astype(np.uint16)


def packed(p: np.ndarray) -> bytes:
    """A point as bytes, one a group where the counts allow it and two otherwise."""
    return (p.astype(np.uint8) if p.max() < 256 else p).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == groups_for(n) else np.uint16).astype(np.uint16)


def folded(p: np.ndarray, size: int) -> np.ndarray:
    return p if len(p) == size else p.reshape(-1, size).sum(0).astype(np.uint16)


def least_overlap(a, b, percent: int):
    """The smallest overlap of sets of a and b tokens with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    n = overlap(a, b)
    return 100 * n >= percent * (len(a) + len(b) - n) and n > 0


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Tree:
    """A packed R-tree over points: leaves of LEAF points in order of set size, each with its upper corner and sizes.

    A leaf holds points of one fineness. Linked sets differ in size by a quarter at most, so a leaf meets leaves of its own
    fineness and of the next one, which are folded onto it.
    """

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]):
        self.order = np.lexsort((np.array([int(p[0]) for p in points]), sizes))
        self.sizes = sizes[self.order]
        self.leaves: list[tuple[int, int]] = []  # bounds in the order
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # fineness: points, upper corners of leaves, first leaf
        dims = np.array([len(points[i]) for i in self.order])
        self.level = dims
        for d in np.unique(dims).tolist():
            lo, hi = np.searchsorted(dims, [d, d + 1])
            cuts = np.arange(lo, hi, LEAF)
            held = np.array([points[i] for i in self.order[lo:hi]])
            self.levels[d] = held, np.maximum.reduceat(held, cuts - lo, axis=0), len(self.leaves)
            self.leaves += list(zip(cuts.tolist(), np.append(cuts[1:], hi).tolist()))
        self.low, self.high = self.sizes[[a for a, _ in self.leaves]], self.sizes[[b - 1 for _, b in self.leaves]]

    def _points(self, leaf: int, dims: int) -> np.ndarray:
        a, b = self.leaves[leaf]
        held, _, first = self.levels[int(self.level[a])]
        base = self.leaves[first][0]
        part = held[a - base : b - base]
        return part if part.shape[1] == dims else part.reshape(len(part), -1, dims).sum(1)

    def near(self, leaf: int, percent: int) -> list[int]:
        """Leaves from `leaf` on whose points may reach the similarity with one of its points."""
        dims = int(self.level[self.leaves[leaf][0]])
        _, upper, first = self.levels[dims]
        mine, out = upper[leaf - first], []
        for d in (dims, 2 * dims):
            if d in self.levels:
                _, corners, start = self.levels[d]
                corners = corners[max(0, leaf - start) :]
                start = max(start, leaf)
                at = slice(start, start + len(corners))
                corners = corners if d == dims else corners.reshape(len(corners), -1, dims).sum(1)
                bound = np.minimum(corners, mine).sum(1, dtype=np.int64)
                fits = (bound >= least_overlap(self.low[at], self.low[leaf], percent)) & (100 * self.high[leaf] >= percent * self.low[at])
                out += (np.flatnonzero(fits) + start).tolist()
        return out

    def pairs(self, percent: int, forest: Forest) -> Iterator[tuple[int, int]]:
        """Pairs that may be linked and join two parts of the forest, which takes each."""
        for leaf, (a0, a1) in enumerate(self.leaves):
            dims = int(self.level[a0])
            mine = self._points(leaf, dims)
            for other in self.near(leaf, percent):
                b0, b1 = self.leaves[other]
                bound = np.minimum(mine[:, None], self._points(other, dims)[None]).sum(2, dtype=np.int64)
                small, large = self.sizes[a0:a1][:, None], self.sizes[b0:b1][None]
                hit = (bound >= least_overlap(small, large, percent)) & (100 * np.minimum(small, large) >= percent * np.maximum(small, large))
                for i, j in zip(*np.nonzero(hit)):
                    i, j = int(self.order[a0 + i]), int(self.order[b0 + j])
                    if i != j and forest.join(i, j):
                        yield i, j


def frequent_tokens(docs: DataFrame, k: int, per_batch: int = 2048) -> np.ndarray:
    """Tokens that many documents hold: each run of per_batch documents reports those in more than 1 of 500 of them (4 at
    least), over all documents. This only orders tokens; the join is exact whatever is listed. At most MOST_FREQUENT tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))
            use = counts >= max(4, n // 500)
            return pa.RecordBatch.from_arrays([pa.array(tokens[use].view(np.int64)), pa.array(counts[use])], names=["token", "n"])

        for batch in slices(batches, "text"):
            held += shingle_sets(batch.column("text"), k)
            n += batch.num_rows
            if n >= per_batch or sum(map(len, held)) > 1_500_000:
                yield report()
                held, n = [], 0
        yield report()

    found = stage(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 32"), "frequent")
    # how many tokens have each count, in steps of an eighth of a power of two: some hundreds of rows
    step = F.floor(8 * F.log2("n"))
    total, least = 0, None
    for r in found.groupBy(step.alias("step")).agg(F.count("*").alias("tokens"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        total += r.tokens
        if total > MOST_FREQUENT:
            break
        least = r.n
    if least is None:
        return np.zeros(0, U)
    return np.sort(found.filter(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(np.int64).view(U))


def class_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; 0 sums for empty ones."""
    sums = np.array([np.sum(s) for s in sets], U)
    marks = np.array([np.bitwise_xor.reduce(mix64(s)) if len(s) else 0 for s in sets], U)
    return mix64(marks ^ (sums * U(0x9E3779B97F4A7C15)) ^ np.array(list(map(len, sets)), U)).view(np.int64)


def row_key(doc_id: Column, mark: Column) -> Column:
    """Names rows by doc_id (null or not) and the hash of their text: only repeated rows share it."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), mark.cast("string"))


def describe(docs: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n, class (a hash of the set), prefix (tokens that a linked set must share one of), point."""
    listed = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = listed.value
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            prefixes, points = [], []
            for s in sets:
                n = len(s)
                if not n:
                    prefixes.append(s)
                    points.append(b"")
                    continue
                size = n - -(-percent * n // 100) + 1
                late = np.zeros(n, bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                early = s[~late][:size]
                prefixes.append(np.concatenate((early, s[late][: size - len(early)])) if len(early) < size else early)
                points.append(packed(point(s)))
            offsets = np.concatenate(([0], np.cumsum(list(map(len, prefixes)))))
            flat = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((np.concatenate(prefixes) if prefixes else np.zeros(0, U)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(list(map(len, sets)), pa.int64()), pa.array(class_hashes(sets)), flat, pa.array(points, pa.binary())], names=["doc_id", "mark", "n", "class", "prefix", "point"])

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return read.mapInArrow(run, "doc_id long, mark long, n long, class long, prefix array<long>, point binary")


def gatherings(postings: DataFrame) -> DataFrame:
    """(gathering, class): the sets of classes that share a token. Tokens that gather the same classes give one gathering."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long_one = None  # a token that outgrew the hold: its rows pass on one by one

        def found(t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]))) if len(t) else np.zeros(0, bool)
            t, c = t[fresh], c[fresh]
            starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(t)))
            many = sizes > 1
            key = mix64(np.add.reduceat(mix64(c.view(U)), starts) + sizes.astype(U)) if len(starts) else np.zeros(0, U)
            first = np.zeros(len(starts), bool)
            first[np.unique(key, return_index=True)[1]] = True
            use = np.repeat(many & first, sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(key, sizes)[use].view(np.int64)), pa.array(c[use])], names=["gathering", "class"])

        for batch in batches:
            t, c = batch.column("token").to_numpy(), batch.column("class").to_numpy()
            if long_one is not None:
                same = t == long_one
                if same.any():
                    yield pa.RecordBatch.from_arrays([pa.array(t[same]), pa.array(c[same])], names=["gathering", "class"])
                    t, c = t[~same], c[~same]
                if not len(t):
                    continue
                long_one = None
            token, cls = np.concatenate((token, t)), np.concatenate((cls, c))
            if not len(token):
                continue
            end = np.searchsorted(token, token[-1]) if (token[1:] >= token[:-1]).all() else len(token)
            if len(token) - end > 1 << 16:
                long_one = token[-1]
                yield pa.RecordBatch.from_arrays([pa.array(token[end:]), pa.array(cls[end:])], names=["gathering", "class"])
                yield found(token[:end], cls[:end])
                token, cls = token[:0], cls[:0]
            else:
                yield found(token[:end], cls[:end])
                token, cls = token[end:], cls[end:]
        yield found(token, cls)

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(n, "token").sortWithinPartitions("token", "class").mapInArrow(run, "gathering long, class long")


def split_large(members: DataFrame, most: int = TREE) -> DataFrame:
    """Gatherings above `most` become pairs of blocks, each pair a gathering of its own: every pair of members meets in one."""
    sizes = members.groupBy("gathering").agg(F.count("*").alias("m")).filter(f"m > {most // 2}")
    sizes = stage(sizes.select("gathering", F.ceil(F.col("m") / (most // 2)).cast("long").alias("blocks")), "large")
    marked = members.join(sized(sizes), "gathering", "left")
    block = F.pmod(F.xxhash64("class", "gathering"), F.col("blocks"))
    whole = marked.filter("blocks IS NULL OR blocks <= 2").drop("blocks")
    pairs = marked.filter("blocks > 2").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    # members of one block meet wherever it meets another
    key = F.xxhash64("gathering", F.least("block", "other"), F.greatest("block", "other"))
    return whole.unionByName(pairs.filter("block <> other").select(key.alias("gathering"), "class"))


def _grouped(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of sorted batches, group by group. Callers bound the groups."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        ks = list(zip(*[columns[k] for k in keys]))
        start = 0
        for i in range(1, len(ks) + 1):
            if i == len(ks) or ks[i] != ks[start]:
                if now is not None and ks[start] != now:
                    yield now, held
                    held = {}
                now = ks[start]
                for c, v in columns.items():
                    held.setdefault(c, []).extend(v[start:i])
                start = i
    if now is not None:
        yield now, held


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each gathering a spanning forest of the pairs that its tree lets through. members: gathering, class, n, point."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for _, g in _grouped(batches, ("gathering",)):
            points = [unpacked(p, n) for p, n in zip(g["point"], g["n"])]
            tree = Tree(np.array(g["n"], np.int64), points)
            out.update((min(a, b), max(a, b)) for a, b in ((g["class"][i], g["class"][j]) for i, j in tree.pairs(percent, Forest(len(points)))))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in sorted(out)], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                out = set()
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in sorted(out)], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, "gathering").sortWithinPartitions("gathering").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, by alternating large and small stars.
    edges: a, b with a <> b. Every round is written out; it ends when a round changes nothing. A node's least neighbour is
    looked up by broadcast only while the edges, which bound the nodes, are counted as few."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    measure = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    mark = measure(edges)
    while mark[0]:
        few = 2 * mark[0] <= BROADCAST_ROWS
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(sized(low, rows=2 * mark[0]), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else stage(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(sized(low, rows=2 * mark[0]), "u")
        arms = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stage(joined.select(F.inline(arms)).filter("u <> v").distinct(), "small-star")
        new = measure(edges)
        if new == mark:
            break
        mark = new
    # every node but a root now has one edge, to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted's columns and the set of each wanted class, read from the text of its row `rep`, `mark`. The class is taken from
    the text again, so that no other row's set comes under it, and one of repeated rows is read."""
    base = docs.select("text", row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"))
    keyed = wanted.select(row_key(F.col("rep"), F.col("mark")).alias("key"))
    few = bloom.probe(base, F.col("key"), bloom.build(keyed, "key", wanted.count())).filter("possible").select("row.text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([pa.array(class_hashes(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "tokens"])

    sets = few.mapInArrow(run, "class long, tokens binary").dropDuplicates(["class"])
    return sets.join(sized(wanted.drop("rep", "mark")), "class")


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, members: DataFrame, k: int, percent: int, block: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """(a, b): links that span what is linked inside the candidate clusters. clusters: class, cluster. members: gathering, class.
    A block has about `block` classes on a side at most (half as many loose ones) and about block_bytes of their sets."""
    n, total = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), clusters.count()
    degree = members.join(sized(clusters.select("class"), rows=total), "class", "left_semi").groupBy("class").agg(F.count("*").alias("degree"))
    held = classes.select("class", "rep", "mark", "n").join(sized(clusters, rows=total), "class").join(sized(degree, rows=total), "class", "left")
    held = stage(held, "clusters")
    best = F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.col("class").alias("c"))
    blocks = lambda sets, size: F.ceil(F.greatest(F.count("*") / sets, F.sum(8 * F.col("n")) / size)).cast("long")
    pivots = stage(held.groupBy("cluster").agg(F.max_by("class", best).alias("pivot"), blocks(block, block_bytes).alias("parts"), F.count("*").alias("members")), "pivots")
    # the pivot goes to each part of its cluster and is read first there
    dealt = held.join(sized(pivots, rows=total), "cluster").withColumn("is_pivot", F.col("class") == F.col("pivot"))
    part = F.when(F.col("is_pivot"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("parts"))))
    dealt = stage(dealt.select("cluster", "class", "rep", "mark", "is_pivot", F.explode(part).alias("part")), "dealt")

    def against_pivot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, pivot_class = None, None, None
        for batch in slices(batches, "tokens"):
            out = []
            for cluster, part, cls, first, tokens in zip(*[batch.column(c).to_pylist() for c in ("cluster", "part", "class", "is_pivot", "tokens")]):
                s = np.frombuffer(tokens, U)
                if first:
                    now, pivot, pivot_class = (cluster, part), s, cls
                else:
                    assert now == (cluster, part)
                    out.append((cluster, pivot_class, cls, len(s), linked(pivot, s, percent)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.bool_())], names=["cluster", "a", "b", "n", "linked"])

    streamed = sets_of(docs, dealt, k).repartition(n, "cluster", "part").sortWithinPartitions("cluster", "part", F.desc("is_pivot"))
    first = stage(streamed.mapInArrow(against_pivot, "cluster long, a long, b long, n long, linked boolean"), "pivoted")
    links = first.filter("linked").select("a", "b")
    # what the pivot leaves, against all of its cluster
    left = first.filter("NOT linked").select("cluster", F.col("b").alias("class"), "n")
    open_ = left.groupBy("cluster").agg(blocks(block // 2, block_bytes).alias("rows")).join(sized(pivots.filter("members > 2"), rows=total), "cluster")
    open_ = stage(open_, "open")
    if not open_.count():
        return links
    rest = held.join(sized(open_, rows=total), "cluster").join(sized(left.select("class", F.lit(True).alias("loose")), rows=total), "class", "left")
    rest = rest.filter("class <> pivot").withColumn("loose", F.coalesce("loose", F.lit(False)))
    rest = rest.select("cluster", "class", "rep", "mark", "loose", "rows", F.col("parts").alias("cols"))
    as_row = rest.filter("loose").withColumn("i", F.pmod(F.xxhash64("class"), F.col("rows"))).withColumn("j", F.explode(F.expr("sequence(0L, cols - 1)"))).withColumn("side", F.lit(0))
    as_col = rest.withColumn("j", F.pmod(F.xxhash64("class"), F.col("cols"))).withColumn("i", F.explode(F.expr("sequence(0L, rows - 1)"))).withColumn("side", F.lit(1))
    both = stage(as_row.unionByName(as_col).select("cluster", "i", "j", "side", "class", "rep", "mark", "loose"), "blocks")

    def in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in _grouped(batches, ("cluster", "i", "j")):
            names = sorted(set(g["class"]))
            index = {c: x for x, c in enumerate(names)}
            sets: list[np.ndarray] = [None] * len(names)  # type: ignore[list-item]
            forest, tied = Forest(len(names)), None
            rows_, cols_ = [], []
            for cls, side, loose, tokens in zip(g["class"], g["side"], g["loose"], g["tokens"]):
                x = index[cls]
                sets[x] = np.frombuffer(tokens, U)
                (cols_ if side else rows_).append(x)
                if not loose:
                    tied = x if tied is None else tied
                    forest.join(tied, x)
            sizes = np.array(list(map(len, sets)))
            points = [point(s) for s in sets]
            fineness = np.array(list(map(len, points)))
            cols_ = np.array(sorted(cols_, key=lambda x: sizes[x]), dtype=int)
            out = []
            for x in rows_ if len(cols_) else []:
                lo, hi = np.searchsorted(sizes[cols_], [-(-percent * sizes[x] // 100), 100 * sizes[x] // percent + 1])
                for y in cols_[lo:hi].tolist():
                    if forest.root(x) != forest.root(y):
                        dims = min(fineness[x], fineness[y])
                        bound = int(np.minimum(folded(points[x], dims), folded(points[y], dims)).sum(dtype=np.int64))
                        if bound >= least_overlap(sizes[x], sizes[y], percent) and linked(sets[x], sets[y], percent):
                            forest.join(x, y)
                            out.append((names[x], names[y]))
            columns = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    met = sets_of(docs, both, k).repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return links.unionByName(met.mapInArrow(in_blocks, "a long, b long"))


def grouped(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, mark, n, group, component for every row of docs. Rows of one component share `group`, whatever their doc_id; it
    is null where a row has no other in its component. component is the least doc_id of the group."""
    described = stage(describe(docs, frequent_tokens(docs, k), k, percent), "described")
    some = described.filter("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    classes = some.groupBy("class").agg(least.alias("least"), F.min("n").alias("n"), F.min("point").alias("point"), F.count("*").alias("size"))
    classes = stage(classes.select("class", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("mark"), "n", "point", "size"), "classes")
    postings = some.select("class", F.explode("prefix").alias("token"))
    members = stage(gatherings(postings).distinct(), "gatherings")
    tree_members = split_large(members).join(classes.select("class", "n", "point").hint("merge"), "class")
    edges = stage(candidates(tree_members, percent), "candidates")
    clusters = components(edges).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    links = stage(verified(docs, classes, clusters, members, k, percent), "links")
    joined = components(links).select(F.col("node").alias("class"), "root")
    nodes = joined.count()
    joined = stage(classes.select("class", "rep").join(sized(joined, rows=nodes), "class"), "joined")
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    joined = joined.join(sized(least, rows=nodes), "root").select("class", F.col("root").alias("group"), "component")
    # only classes of several rows or in a component need a look-up
    alone = classes.filter("size > 1").join(sized(joined.select("class"), rows=nodes), "class", "left_anti")
    named = alone.select("class", F.col("class").alias("group"), F.col("rep").alias("component")).unionByName(joined)
    named = stage(named, "components")
    plain = described.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return plain.join(sized(named), "class", "left").drop("class")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Words are lower-cased (A-Z) runs without white space, whole texts are read. Sets of k-word shingles link at
    100 * intersection >= percent * union; fewer words are one shingle; null texts and texts without words have an empty
    set, no link and their own doc_id as component. Components carry their smallest doc_id, which is null only where no row
    of the component has one. Rows are told apart by their sets, not by doc_id; repeated rows fall in one class. An empty
    table gives no row; further columns are ignored. Sets are held as 64-bit hashes.
    """
    out = grouped(docs, k, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def copies(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The row_key of every row that goes when one of each component stays: the one with the smallest doc_id (null last), then
    the least hash of the text. Rows that repeat the one that stays share its key and are not listed."""
    rows = stage(grouped(docs, k, percent).filter("group IS NOT NULL").select("doc_id", "mark", "group"), "grouped")
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("kept"))
    kept = kept.select("group", F.col("kept.doc_id").alias("kept_id"), F.col("kept.mark").alias("kept_mark"))
    gone = rows.join(sized(kept), "group").filter("NOT (doc_id <=> kept_id AND mark = kept_mark)")
    return gone.select(row_key(F.col("doc_id"), F.col("mark")).alias("dropped")).distinct()
