"""Jaccard join of documents as points of a metric space.

A document's point is its set of distinct SIZE-word shingles (a shorter text: its words as one shingle), as 64-bit hashes;
documents with equal sets are one class. The distance 1 - |A & B| / |A | B| obeys the triangle inequality. Two points
link when their distance is at most EPS.

Regions. Pivots of a first kind are the sets of one shingle: two points that link share MARGIN |A| + 1 or more of the
first (EPS + MARGIN) |A| + 1 shingles of both, in any fixed order of shingles, so the points that have a shingle among
these form a region, and every link lies in one. Points that share fewer of their first shingles with any others link with
none. Frequent shingles come last in the order. A region is named by its least point, and regions of one name are joined
as one; of these, points with no other of a size near enough are left out. The distances to pivots inside a region settle most
of it: with pivot q, points within EPS of q link to it; if every point outside q's component is farther from q than
d(x, q) + EPS, then x has no other links that matter, and is done. What is left is split into Voronoi regions of several
pivots. A point joins the region of its nearest pivot, and (window) each one whose pivot is not farther than that by more
than 2 EPS; a last region has the points that are nowhere near a pivot. Each region is joined in the same way, down to
single pivots, so the result is exact. Regions that fit a task are joined there; larger ones are split over the cluster by
the same rules first, in which each task needs its rows and the pivots only.

The result has components, for which links that lie inside a known component need not be listed: a group of near copies is
settled by its pivots without listing its pairs.

Nulls and texts without words have no shingles and link with nothing. A null doc_id counts as larger than any other; a
component of such rows alone has a null component_id. Repeated rows are documents of one class. Classes have 64-bit ids,
and new ones where a second hash shows two classes to have one id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprint.llm.common import bytes_and_bounds, column, cut, pieces, shuffle_partitions, text_key
from blockprint.llm.minimisers import joined, lowered, mixed, ragged_ranges, runs, word_hashes, words_of
from blockprint.operators.components import components

SIZE, PERCENT = 5, 80
#: Of a point's shingles, so many in a hundred are looked at beyond those that a link may lack.
MARGIN_PERCENT = 10
#: Shingles and points of a region that one task joins; larger regions are split over the cluster.
REGION, POINTS = 3_000_000, 10_000
#: In a region, shingles that more than a DENSE-th of the points have are multiplied as a matrix, for BATCH pivots at once.
DENSE, BATCH = 8, 64
#: A shingle that so many documents of one piece of a task have may be frequent; at most so many are known to all tasks.
OFTEN, MOST_FREQUENT = 4, 200_000
PIVOTS, ROUNDS, PIVOT_BYTES = 24, 4, 48 << 20
#: Pivots that would put a region's points into so many new regions on average do not split it.
MOST_COPIES = 2
SLACK = 1e-9
U = np.uint64


# ---- points --------------------------------------------------------------------------------------------------------


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one text after another, and their number."""
    data = lowered(data)
    starts, ends, lengths = words_of(data, bounds)
    words = word_hashes(data, starts, ends)
    first = np.cumsum(lengths) - lengths
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    owner, place = ragged_ranges(counts)
    a, wide = first[owner] + place, np.minimum(lengths[owner], size)
    h = mixed(wide.astype(np.uint64))
    for k in range(size):
        rows = slice(None) if k == 0 else np.flatnonzero(wide > k)
        h[rows] = joined(h[rows], words[a[rows] + k])
    order = by_owner(np.argsort(h), owner)
    h, owner = h[order], owner[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    return h[keep], np.bincount(owner[keep], minlength=len(lengths))


def by_owner(order: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """An order made stable by owner. Small numbers are sorted by their digits."""
    key = owner[order]
    return order[np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")]


def lacking(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles a set that links may lack at most."""
    return n - (percent * n + 99) // 100


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that pieces of tasks have often, at most MOST_FREQUENT by number of documents; only the order of shingles
    depends on them, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, _ = shingles(*bytes_and_bounds(column(part, "text")))
                values, n = np.unique(h, return_counts=True)
                often = n >= OFTEN
                yield pa.record_batch({"shingle": values[often].view(np.int64), "n": n[often].astype(np.int64)})

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    return np.sort(top.column("shingle").to_numpy().view(np.uint64))


def points(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """doc_id, key, n, cid and cid2 (hashes of the set; null if empty) and prefix: the shingles through which links are looked for,
    for the first document of each class in a piece of a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, n = shingles(*bytes_and_bounds(column(part, "text")))
                owner, cid = np.repeat(np.arange(len(n)), n), class_ids(h, n)
                known = shared.value
                late = np.zeros(len(h), bool)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    late = known[at] == h
                order = by_owner(np.arange(len(h)), 2 * owner + late)
                h, (_, place) = h[order], ragged_ranges(n)
                first = np.zeros(len(n), bool)
                first[np.unique(cid, return_index=True)[1]] = True
                length = np.where(first, lacking(n, percent) + MARGIN_PERCENT * n // 100 + 1, 0)
                length[n == 0] = 0
                take = place < length[owner]
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": column(part, "doc_id"),
                        "key": column(part, "key"),
                        "n": pa.array(n, pa.int64()),
                        "cid": pa.array(cid.view(np.int64), mask=n == 0),
                        "cid2": pa.array(class_ids(h, n, 1).view(np.int64), mask=n == 0),
                        "prefix": pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[take].view(np.int64))),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n long, cid long, cid2 long, prefix array<long>")


def class_ids(h: np.ndarray, n: np.ndarray, lane: int = 0) -> np.ndarray:
    """64 bits of each set, in two lanes that are independent of each other."""
    sums = np.append(U(0), np.cumsum(mixed(h * U(2 * lane + 1) + U((0x51ED27, 0x9D8A7C3F5B21)[lane]))))
    ends = np.cumsum(n)
    return mixed((sums[ends] - sums[ends - n]) ^ (n.astype(np.uint64) << U(40)))


# ---- joins inside a region -----------------------------------------------------------------------------------------


class Region:
    """Points of one region in memory: links() joins them."""

    def __init__(self, cids: np.ndarray, sets: list[np.ndarray], percent: int):
        self.cids, self.percent, self.eps = cids, percent, 1 - percent / 100
        self.n = np.array([len(s) for s in sets], np.int64)
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        some = (count > 1)[inverse]  # shingles of one point only count in its size
        owner, shingle = owner[some], inverse[some]
        by = np.argsort(shingle, kind="stable")
        self.posting = owner[by]
        self.posting_at = np.searchsorted(shingle[by], np.arange(len(values) + 1))
        # Shingles that the same points have (those of a shared passage) count as one of their number's weight.
        self.weight, stands_for = alike(self.posting, self.posting_at)
        lead = stands_for[shingle] == shingle
        # Shingles that many points have are columns of a matrix, the others lists of points.
        long = np.diff(self.posting_at) > max(16, len(sets) // DENSE)
        columns = np.cumsum(long & (stands_for == np.arange(len(values)))) - 1
        some = lead & long[shingle]
        self.dense = np.zeros((len(sets), int(columns[-1]) + 1 if len(columns) else 0), np.float32)
        self.dense[owner[some], columns[shingle[some]]] = 1
        self.weighted = self.dense * self.weight[long & (stands_for == np.arange(len(values)))].astype(np.float32)
        some = lead & ~long[shingle]
        self.shingle = shingle[some]
        self.row_at = np.searchsorted(owner[some], np.arange(len(sets) + 1))
        self.label = np.arange(len(sets))

    def distances(self, q: int, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """From point q to all: distance, and whether they link (in whole numbers). dense: what the matrix gives for q."""
        dense = self.dense @ self.weighted[q] if dense is None else dense
        mine = self.shingle[self.row_at[q] : self.row_at[q + 1]]
        a, b = self.posting_at[mine], self.posting_at[mine + 1]
        which, place = ragged_ranges(b - a)
        both = np.bincount(self.posting[a[which] + place], self.weight[mine][which], len(self.n)).astype(np.int64)
        both += dense.astype(np.int64)
        both[q] = self.n[q]
        union = self.n[q] + self.n - both
        return 1 - both / union, 100 * both >= self.percent * union

    def link(self, q: int, linked: np.ndarray) -> None:
        joined_labels = np.unique(np.append(self.label[linked], self.label[q]))
        if len(joined_labels) > 1:
            self.label[np.isin(self.label, joined_labels[1:])] = joined_labels[0]

    def sweep(self, members: np.ndarray) -> None:
        """Joins members by one pivot after another."""
        done = np.zeros(len(self.n), bool)
        inside = np.zeros(len(self.n), bool)
        inside[members] = True
        at, size = 0, 1
        while at < len(members):
            some = members[at : at + size]
            some = some[~done[some]]
            at, size = at + size, min(2 * size, BATCH)
            dense = self.weighted[some] @ self.dense.T
            for q, row in zip(some.tolist(), dense, strict=True):
                if not done[q]:
                    d, linked = self.distances(q, row)
                    self.link(q, linked & inside)
                    self.settle(q, d, members, done)
                    done[q] = True

    def settle(self, q: int, d: np.ndarray, members: np.ndarray, done: np.ndarray) -> None:
        """Marks the members of q's component that no member outside of it can reach."""
        near = members[d[members] < 1]
        same = self.label[near] == self.label[q]
        others = d[near[~same]]
        nearest = others.min() if len(others) else 1.0 if len(near) < len(members) else np.inf
        mine = near[same]
        done[mine[d[mine] + self.eps + SLACK < nearest]] = True

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        if len(members) <= 512 or depth > 20:
            self.sweep(members)
            return
        rng = np.random.default_rng(depth)
        pivots = np.sort(rng.choice(members, 16, replace=False))
        d = np.empty((len(pivots), len(members)))
        done = np.zeros(len(self.n), bool)
        inside = np.zeros(len(self.n), bool)
        inside[members] = True
        every = []
        for k, q in enumerate(pivots.tolist()):
            x, linked = self.distances(q)
            self.link(q, linked & inside)
            every.append(x)
            d[k] = x[members]
        for q, x in zip(pivots.tolist(), every, strict=True):
            self.settle(q, x, members, done)
        done[pivots] = True
        # Points that are done need not be compared with each other, and reach nothing outside their component.
        open_ = ~done[members]
        parts = [part for cell in cells(d, self.eps) if len(part := members[cell & open_]) > 1]
        # A sweep takes a step for each point at most; cells that copy points to more than these would multiply steps at every depth.
        if sum(map(len, parts)) > open_.sum():
            self.sweep(members[open_])
            return
        for part in parts:
            self.join(part, depth + 1)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self.join(np.arange(len(self.n)))
        linked = self.label != np.arange(len(self.n))
        return self.cids[linked], self.cids[self.label[linked]]


def alike(posting: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of posting lists (between the bounds `at`): how many are equal to each, and the first that is. Lists are grouped by
    a hash and compared."""
    n = len(at) - 1
    size = np.diff(at)
    weight, first_of = np.ones(n), np.arange(n)
    sums = np.append(U(0), np.cumsum(mixed(posting.astype(np.uint64) + U(1))))
    key = mixed((sums[at[1:]] - sums[at[:-1]]) ^ mixed(size.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    order = order[size[order] > 1]
    start, end = runs(key[order], size[order])
    of = np.empty(n, np.int64)
    of[order] = np.repeat(order[start], end - start)
    rows = order[of[order] != order]  # all but the first of each group
    which, place = ragged_ranges(size[rows])
    differ = posting[at[rows][which] + place] != posting[at[of[rows]][which] + place]
    unlike = np.zeros(len(rows), bool)
    unlike[which[differ]] = True
    same = rows[~unlike]
    first_of[same] = of[same]
    np.add.at(weight, of[same], 1)
    return weight, first_of


def cells(d: np.ndarray, eps: float) -> list[np.ndarray]:
    """Voronoi regions with windows, from distances (pivots x points): a mask of points for each pivot, then the last
    region of points that are far from all pivots. Two points within eps of each other share one at least."""
    least = d.min(axis=0)
    return [*((d <= least + 2 * eps + SLACK) & (d < 1)), least >= 1 - 2 * eps - SLACK]


def region_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked in each region; rows: region, x, set (packed shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, list[bytes]]] = []

        def close() -> None:
            cids = np.concatenate([c for c, _ in held])
            cids, at = np.unique(cids, return_index=True)
            if len(cids) > 1:
                raw = [s for _, part in held for s in part]
                found.append(Region(cids, [np.frombuffer(raw[i], np.uint64) for i in at.tolist()], percent).links())
            held.clear()

        last = None
        for batch in batches:
            region, x = column(batch, "region").to_numpy(), column(batch, "x").to_numpy()
            sets = column(batch, "set")
            for a, b in zip(*runs(region), strict=True):
                if held and region[a] != last:
                    close()
                last = region[a]
                held.append((x[a:b], sets.slice(a, b - a).to_pylist()))
            if found:
                yield pa.record_batch({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})
                found.clear()
        if held:
            close()
        if found:
            yield pa.record_batch({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    spread = rows.select("region", "x", "set").repartition(shuffle_partitions(rows.sparkSession), "region").sortWithinPartitions("region")
    return spread.mapInArrow(run, "a long, b long")


# ---- regions over the cluster --------------------------------------------------------------------------------------


def memberships(pts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (p, x, n): point x, of n shingles, is in the region named p. Rows of a shingle come in the order of
    points; the first names the region, so nothing but it is kept of a shingle, however many points have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_x, leader, alone = None, None, None, False  # alone: the open shingle has one point so far
        for batch in batches:
            s, x = column(batch, "shingle").to_numpy(), column(batch, "cid").to_numpy()
            if not len(s):
                continue
            again = np.append((s[0] == last) and (x[0] == last_x), (s[1:] == s[:-1]) & (x[1:] == x[:-1]))
            last_x = x[-1]
            s, x = s[~again], x[~again]
            if not len(s):
                continue
            new = np.append(s[0] != last, s[1:] != s[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(s))
            head = first[0] if len(first) else len(s)  # rows of the shingle that was open
            leaders = np.concatenate([np.full(head, leader if head else 0, np.int64), np.repeat(x[first], ends - first)])
            several = np.repeat(ends - first > 1, ends - first)
            take = np.concatenate([np.ones(head, bool), several])
            p, q = leaders[take], x[take]
            if head and alone:  # the open shingle's first point has company now
                p, q = np.append(p, leader), np.append(q, leader)
            if len(first):
                leader, alone = x[first[-1]], ends[-1] - first[-1] == 1
            else:
                alone = False
            last = s[-1]
            if len(p):
                order = np.lexsort((q, p))
                a, b = runs(p[order], q[order])
                yield pa.record_batch({"p": p[order][a], "x": q[order][a], "times": pa.array(b - a, pa.int64())})

    rows = pts.select(F.explode("prefix").alias("shingle"), "cid")
    rows = rows.repartition(shuffle_partitions(pts.sparkSession), "shingle").sortWithinPartitions("shingle", "cid")
    found = cut(rows.mapInArrow(run, "p long, x long, times long").groupBy("p", "x").agg(F.sum("times").alias("times")))
    # A point that links has MARGIN_PERCENT of its shingles and one more in common with others.
    enough = found.groupBy(F.col("x").alias("cid")).agg(F.sum("times").alias("_times")).join(classes, "cid")
    enough = enough.where(F.col("_times") >= F.floor(F.col("n") * MARGIN_PERCENT / 100) + 1).select("cid", "n")
    kept = found.join(enough, F.col("x") == F.col("cid")).select("p", "x", "n")
    return cut(near_in_size(kept, percent))


def near_in_size(members: DataFrame, percent: int) -> DataFrame:
    """(p, x, n) without points of whose region no other point has a size that allows a link. The sizes of a region are
    counted first, by partial sums; so no task needs all points of one region."""
    sizes = members.groupBy("p", "n").agg(F.count("*").alias("_k"))
    by = Window.partitionBy("p").orderBy("n")
    below, above = F.lag("n").over(by), F.lead("n").over(by)
    near = (F.col("_k") > 1) | (100 * below >= percent * F.col("n")) | (100 * F.col("n") >= percent * above)
    sizes = sizes.withColumn("_near", F.coalesce(near, F.lit(False))).where("_near").select(F.col("p").alias("_p"), F.col("n").alias("_n"))
    return members.join(sizes, (F.col("p") == F.col("_p")) & (F.col("n") == F.col("_n")), "left_semi")


def region_rows(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """region, x, n, set for each membership; the sets are made once from the text of a class's first document."""
    lists = members.groupBy("x").agg(F.collect_list("p").alias("of"))
    lists = lists.join(classes, F.col("x") == F.col("cid")).select("x", "of", F.col("first_id").alias("_id"), F.col("first_key").alias("_key"))
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    rows = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, n = shingles(*bytes_and_bounds(column(part, "text")))
                ends = np.cumsum(n)
                of = column(part, "of")
                count = np.diff(of.offsets.to_numpy())
                who = np.repeat(np.arange(part.num_rows), count)
                regions = of.flatten()
                raw = h.tobytes()
                sets = [raw[8 * (e - k) : 8 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                for i in range(0, len(who), 2000):
                    w = who[i : i + 2000]
                    yield pa.record_batch({"region": regions.slice(i, 2000), "x": column(part, "x").take(pa.array(w)), "n": pa.array(n[w], pa.int64()), "set": pa.array([sets[k] for k in w.tolist()], pa.binary())})

    return rows.select("x", "of", "text").mapInArrow(run, "region long, x long, n long, set binary")


def intersections(mine: np.ndarray, pivot_values: np.ndarray, pivot_of: np.ndarray, k: int) -> np.ndarray:
    """How many shingles the sorted set has in common with each of k pivots (values sorted, with their pivots)."""
    at = np.searchsorted(mine, pivot_values)
    hit = at < len(mine)
    hit[hit] = mine[at[hit]] == pivot_values[hit]
    return np.bincount(pivot_of[hit], minlength=k)


def split_round(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One round over regions that are too large for a task: links to pivots, and the rows that are left, in new regions;
    whole: of regions that the pivots do not split, as their points would join most of the new ones.

    Pivots of a region are the points with the least hash in each of PIVOTS hash classes. Their sets go to all tasks, for
    so many regions at a time as PIVOT_BYTES allow.
    """
    spark, eps = rows.sparkSession, 1 - percent / 100
    hashed = rows.withColumn("_h", F.xxhash64("x")).withColumn("_b", F.pmod("_h", F.lit(PIVOTS)))
    chosen = hashed.groupBy("region", "_b").agg(F.min_by(F.struct("x", "set"), F.struct("_h", "x")).alias("_p")).select("region", "_p.x", "_p.set")
    chosen = cut(chosen)
    weights = chosen.groupBy("region").agg(F.sum(F.octet_length("set")).alias("bytes")).orderBy("region").toLocalIterator()
    groups: list[list[int]] = [[]]
    size = 0
    for r in weights:
        if size + r["bytes"] > PIVOT_BYTES and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(r["region"])
        size += r["bytes"]
    links, left = [], []
    for group in groups:
        of_group = F.broadcast(spark.createDataFrame([(r,) for r in group], "region long"))  # as few as their pivots' bytes allow
        a, b = split_group(rows.join(of_group, "region", "left_semi"), chosen.join(of_group, "region", "left_semi"), spark, percent, eps)
        links.append(cut(a))
        left.append(b)
    return union(links), cut(union(left))


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def split_group(rows: DataFrame, chosen: DataFrame, spark, percent: int, eps: float) -> tuple[DataFrame, DataFrame]:
    pivots: dict[int, tuple] = {}
    table: dict[int, list] = {}
    for r in chosen.orderBy("region", "x").collect():
        table.setdefault(r["region"], []).append((r["x"], np.frombuffer(bytes(r["set"]), np.uint64)))
    for region, ps in table.items():
        values = np.concatenate([s for _, s in ps])
        of = np.repeat(np.arange(len(ps)), [len(s) for _, s in ps])
        by = np.argsort(values, kind="stable")
        pivots[region] = (np.array([x for x, _ in ps]), np.array([len(s) for _, s in ps]), values[by], of[by])
    shared = spark.sparkContext.broadcast(pivots)

    def measure(region: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        _, sizes, values, of = shared.value[region]
        mine = np.frombuffer(raw, np.uint64)
        both = intersections(mine, values, of, len(sizes))
        union = sizes + len(mine) - both
        return 1 - both / union, 100 * both >= percent * union

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = column(batch, "region").to_pylist()
            found = [measure(r, s) for r, s in zip(region, column(batch, "set").to_pylist(), strict=True)]
            yield pa.record_batch({"region": column(batch, "region"), "x": column(batch, "x"), "d": pa.array([d.astype("<f8").tobytes() for d, _ in found], pa.binary()), "linked": pa.array([np.flatnonzero(k).astype(np.int32).tolist() for _, k in found], pa.list_(pa.int32()))})

    table_ = cut(rows.mapInArrow(distances, "region long, x long, d binary, linked array<int>"))
    # Components of pivots: two pivots to which one point is linked.
    joined = table_.where("size(linked) > 1").select("region", F.col("linked")[0].alias("a"), F.explode("linked").alias("b")).distinct()
    parent = {r: list(range(len(p[0]))) for r, p in pivots.items()}

    def root(region: int, i: int) -> int:
        while parent[region][i] != i:
            i = parent[region][i]
        return i

    for r in joined.toLocalIterator():  # PIVOTS * PIVOTS for each region at most
        a, b = root(r["region"], r["a"]), root(r["region"], r["b"])
        parent[r["region"]][max(a, b)] = min(a, b)
    roots = {r: np.array([root(r, i) for i in range(len(p))]) for r, p in parent.items()}
    of_pivots = spark.sparkContext.broadcast(roots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            for region, d, linked in zip(*(column(batch, c).to_pylist() for c in ("region", "d", "linked")), strict=True):
                r = of_pivots.value[region]
                x = np.where(np.isin(r, r[linked]), np.inf, np.frombuffer(d)) if linked else np.frombuffer(d)
                least[region] = np.minimum(least[region], x) if region in least else x
        for region, x in least.items():
            yield pa.record_batch({"region": pa.array([region] * len(x), pa.int64()), "b": pa.array(range(len(x)), pa.int32()), "d": x})

    # How often the points that are left would stand in new regions, and how many they are.
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for region, raw, linked in zip(*(column(batch, c).to_pylist() for c in ("region", "d", "linked")), strict=True):
                d = np.frombuffer(raw)
                if not settled(region, d, linked):
                    t = totals.setdefault(region, [0, 0])
                    t[0] += sum(int(c[0]) for c in cells(d[:, None], eps))
                    t[1] += 1
        if totals:
            yield pa.record_batch({"region": pa.array(list(totals), pa.int64()), "copies": pa.array([t[0] for t in totals.values()], pa.int64()), "points": pa.array([t[1] for t in totals.values()], pa.int64())})

    def settled(region: int, d: np.ndarray, linked) -> bool:
        """Whether a point has no links beyond those to pivots: all that it could reach are in its pivots' component."""
        r = of_pivots.value[region]
        return bool(np.any(np.isin(r, r[linked]) & (d + eps + SLACK < reach.value[region])))

    edges: dict[int, np.ndarray] = {r: np.full(len(p[0]), np.inf) for r, p in pivots.items()}
    for r in table_.mapInArrow(nearest, "region long, b int, d double").groupBy("region", "b").agg(F.min("d").alias("d")).toLocalIterator():
        edges[r["region"]][r["b"]] = r["d"]
    reach = spark.sparkContext.broadcast(edges)
    whole = set()
    for r in table_.mapInArrow(spread, "region long, copies long, points long").groupBy("region").agg(F.sum("copies").alias("copies"), F.sum("points").alias("points")).toLocalIterator():
        if r["copies"] > MOST_COPIES * r["points"]:
            whole.add(r["region"])
    links = table_.select("region", F.col("x").alias("a"), F.explode("linked").alias("_k"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = [int(shared.value[r][0][k]) for r, k in zip(column(batch, "region").to_pylist(), column(batch, "_k").to_pylist(), strict=True)]
            yield pa.record_batch({"a": column(batch, "a"), "b": pa.array(b, pa.int64())})

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, regions, kinds = [], [], []
            for i, (region, raw) in enumerate(zip(column(batch, "region").to_pylist(), column(batch, "set").to_pylist(), strict=True)):
                d, linked = measure(region, raw)
                if settled(region, d, linked):
                    continue
                # Of a region that pivots do not split, the rows stay together; the others go to their cells.
                places = [0] if region in whole else [k + 1 for k, cell in enumerate(cells(d[:, None], eps)) if cell[0]]
                for k in places:
                    keep.append(i)
                    kinds.append(k == 0)
                    regions.append(int(mixed(np.array([np.uint64(region & 0xFFFFFFFFFFFFFFFF) + U(k)], np.uint64)).view(np.int64)[0]))
            at = pa.array(keep, pa.int64())
            yield pa.record_batch({"region": pa.array(regions, pa.int64()), "x": column(batch, "x").take(at), "n": column(batch, "n").take(at), "set": column(batch, "set").take(at), "whole": pa.array(kinds, pa.bool_())})

    return links.mapInArrow(named, "a long, b long"), rows.select("region", "x", "n", "set").mapInArrow(remaining, "region long, x long, n long, set binary, whole boolean")


def blocks(rows: DataFrame) -> DataFrame:
    """Regions that no pivots have split: every two of their blocks of points form a region, so all meet."""
    rows = rows.select("region", "x", "n", "set")
    sizes = rows.groupBy(F.col("region").alias("_of")).agg(F.ceil(F.greatest(F.sum("n") * 2 / REGION, F.count("*") * 2 / POINTS)).cast("int").alias("_k"))
    rows = rows.join(sizes, F.col("region") == F.col("_of")).withColumn("_i", F.pmod(F.xxhash64("x"), F.col("_k")))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    rows = rows.select("*", other.alias("_j"))
    return rows.select(F.xxhash64("region", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("region"), "x", "n", "set")


def links(docs: DataFrame, pts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect every two classes that are linked."""
    members = memberships(pts, classes, percent)
    large_names = cut(members.groupBy(F.col("p").alias("_p")).agg(F.sum("n").alias("_n"), F.count("*").alias("_k")).where((F.col("_n") > REGION) | (F.col("_k") > POINTS)).select("_p"))
    at = F.col("p") == F.col("_p")
    found = [cut(region_links(region_rows(docs, members.join(large_names, at, "left_anti"), classes), percent))]
    # Few regions are large; what is known of them goes through files, as its size decides on the next round.
    large = large_names if large_names.isEmpty() else cut(region_rows(docs, members.join(large_names, at, "left_semi"), classes))
    for _ in range(ROUNDS):
        if large.isEmpty():
            break
        some, left = split_round(large, percent)
        found.append(some)
        sizes = cut(left.groupBy(F.col("region").alias("_r")).agg(F.sum("n").alias("_t"), F.count("*").alias("_k")))
        left = left.join(sizes, F.col("region") == F.col("_r"))
        fits = (F.col("_t") <= REGION) & (F.col("_k") <= POINTS)
        found.append(cut(region_links(left.where(fits), percent)))
        found.append(cut(region_links(blocks(left.where(~fits & F.col("whole"))), percent)))
        large = cut(left.where(~fits & ~F.col("whole")).select("region", "x", "n", "set"))
    if not large.isEmpty():
        found.append(cut(region_links(blocks(large), percent)))
    return cut(union(found).distinct())


def classes_of(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pts, and their classes: cid, n, first_id, first_key. Sets that 128 bits tell apart but that have one cid of 64 (of n
    classes, some n * n / 2**65) get another."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    while True:
        known = pts.where("cid is not null")
        classes = cut(known.groupBy("cid").agg(F.first("n").alias("n"), first.alias("_f"), F.min("cid2").alias("_a"), F.max("cid2").alias("_b")))
        twice = classes.where("_a <> _b").select(F.col("cid").alias("_c"))
        if twice.isEmpty():
            return pts, classes.select("cid", "n", F.col("_f.doc_id").alias("first_id"), F.col("_f.key").alias("first_key"))
        pts = cut(pts.join(twice, F.col("cid") == F.col("_c"), "left").withColumn("cid", F.when(F.col("_c").isNull(), F.col("cid")).otherwise(F.xxhash64("cid", "cid2"))).drop("_c"))


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component_id for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pts = cut(points(docs, frequent_shingles(docs), percent))
    pts, classes = classes_of(pts)
    known = pts.where("cid is not null")
    roots = components(links(docs, known, classes, percent))
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root"), "first_id")
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, F.col("root") == F.col("_root")).select(F.col("cid").alias("_cid"), "component_id")
    out = pts.select("doc_id", "key", "n", "cid").join(placed, F.col("cid") == F.col("_cid"), "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
