"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern can pass its words on
once at no cost, a second time at cost 1 and so on up to `most_repeats` times (convex), to the sources of its pattern;
each source takes its target. Sources that share a pattern form a part; each part's flow is solved by itself, in a task,
so neither the number of sources nor that of patterns is limited and none come to the driver. Documents are then chosen
per pattern in the order of a seeded hash.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; an empty table gives an empty result.
Repeated rows are separate documents. Other columns are kept or ignored, whatever their names. A pattern without sources
is not taken.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprint.llm.common import WORD_PATTERN, column, cut, shuffle_partitions
from blockprint.llm.minimisers import runs
from blockprint.operators.components import components

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MOST_REPEATS = 2
#: Patterns up to this number are broadcast to the documents, more are joined by a shuffle.
BROADCAST_PATTERNS = 100_000
#: Hexadecimal digits that name the slices of the seeded order.
SLICE_DIGITS = 3
#: Columns that mix() adds, each with mix_ before it where docs have one of that name.
RESULTS = ("size", "pattern_words", "pattern_taken", "source_size", "target", "repeats", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `place`: their number by code point, null last. Ranges are numbered each by itself, so no task has all."""
    spread = sources.repartitionByRange(shuffle_partitions(sources.sparkSession), F.col("source").asc_nulls_last())
    rows = cut(spread.withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_k")).select(F.col("_range").alias("_r"), before.alias("_before"))  # a row a range
    return rows.withColumn("_in", inside).join(ranges, F.col("_range") == F.col("_r")).withColumn("place", (F.col("_in") + F.col("_before") - 1).cast("long")).drop("_range", "_r", "_in", "_before")


def with_targets(sources: DataFrame, weights: Sequence[int], total: float, most: int) -> DataFrame:
    """sources (source, place, words) with target: total shared by weight, none above most * words; what is cut off goes to
    the others by weight, again and again. Each round is one sum over the sources."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(sources.withColumn("_weight", weight))
    over, target, capped = F.lit(False), F.lit(0.0), -1
    while True:
        r = rows.agg(F.sum(F.when(~over, F.col("_weight"))).alias("w"), F.sum(F.when(over, most * F.col("words"))).alias("cut"), F.count(F.when(over, 1)).alias("k")).first()
        if r["k"] == capped or not r["w"]:
            break
        capped, target = r["k"], F.lit((total - (r["cut"] or 0)) / r["w"]) * F.col("_weight")
        over = target > most * F.col("words")  # the share of a weight only grows, so what was above stays above
    return rows.withColumn("target", F.when(over, (most * F.col("words")).cast("double")).otherwise(target)).drop("_weight")


def min_cost_flow(supplies: Sequence[int], edges: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern passes to each source; edges[p] are the sources of pattern p.

    A pattern has `repeats` arcs of capacity supplies[p] and costs 0, 1, ...; the other arcs cost nothing. So the cheapest
    augmenting paths are those over arcs of cost 0 as long as there are any, then those of cost 1, and so on; of each cost,
    they are found as blocking flows by level (Dinic). The total is as near to the quotas as capacities allow and, for that
    total, repetition is least.
    """
    n, m = len(supplies), len(quotas)
    sink = n + m + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int) -> None:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(c)

    for p in range(n):
        arc(0, 1 + p, 0)
    for p in range(n):
        for s in edges[p]:
            arc(1 + p, 1 + n + s, supplies[p] * repeats)
    for s in range(m):
        arc(1 + n + s, sink, quotas[s])
    for _ in range(repeats):
        for p in range(n):
            room[2 * p] += supplies[p]
        while True:
            level = [-1] * (sink + 1)
            level[0], queue = 0, deque([0])
            while queue:
                a = queue.popleft()
                for e in arcs[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[sink] < 0:
                break
            at, path, node = [0] * (sink + 1), [], 0
            while True:
                if node == sink:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    first = next(i for i, e in enumerate(path) if not room[e])
                    node = to[path[first] ^ 1]
                    del path[first:]
                while at[node] < len(arcs[node]):
                    e = arcs[node][at[node]]
                    if room[e] and level[to[e]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(arcs[node]):
                    path.append(arcs[node][at[node]])
                    node = to[path[-1]]
                elif path:
                    node = to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break
    return [{to[e] - 1 - n: room[e ^ 1] for e in arcs[1 + p] if n < to[e] < sink and room[e ^ 1]} for p in range(n)]


def flows(patterns: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """_pattern, pattern_taken: the words that the flow takes of each pattern. Parts of sources that share patterns are
    solved each in one task, in the order of their sources."""
    of = patterns.select("_pattern", "words", F.explode("_pattern").alias("_s"))
    of = of.join(sources.select("source", "place"), F.col("_s").eqNullSafe(F.col("source")))
    of = cut(of.groupBy("_pattern", "words").agg(F.array_sort(F.collect_list("place")).alias("places")))
    several = of.where("size(places) > 1")
    quotas = sources.select("place", F.bround("target").cast("long").alias("quota"))
    if several.isEmpty():
        part = quotas.withColumn("part", F.col("place"))
        of = of.withColumn("part", F.col("places")[0])
    else:
        roots = components(several.select(F.col("places")[0].alias("a"), F.explode("places").alias("b")).where("a <> b").distinct())
        part = quotas.join(roots, F.col("place") == F.col("node"), "left").withColumn("part", F.coalesce("root", "place"))
        of = of.join(roots, F.col("places")[0] == F.col("node"), "left").withColumn("part", F.coalesce("root", F.col("places")[0]))
    none = lambda kind: F.lit(None).cast(kind)
    rows = part.select("part", none("array<string>").alias("_pattern"), F.col("quota").alias("words"), F.array("place").alias("places"))
    rows = rows.union(of.select("part", "_pattern", "words", "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            found = sorted(zip(*(table.column(c).to_pylist() for c in ("places", "words", "_pattern")), strict=True), key=lambda r: r[0])
            quota = [(r[0][0], r[1]) for r in found if r[2] is None]
            mine = [r for r in found if r[2] is not None]
            at = {place: i for i, (place, _) in enumerate(quota)}
            flow = min_cost_flow([w for _, w, _ in mine], [[at[k] for k in places] for places, _, _ in mine], [q for _, q in quota], most)
            return pa.record_batch({"_pattern": pa.array([r[2] for r in mine], pa.list_(pa.string())), "pattern_taken": pa.array([sum(f.values()) for f in flow], pa.int64())})

        last = None
        for batch in batches:
            part = column(batch, "part").to_numpy()
            for a, b in zip(*runs(part), strict=True):
                if held and part[a] != last:
                    yield solve()
                last = part[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield solve()

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part")
    return spread.mapInArrow(run, "_pattern array<string>, pattern_taken long")


def seeded(seed: int, key: Sequence[Column]) -> Column:
    """The place of a row in the seeded order: hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in key]))


def mix(docs: DataFrame, size: Column, members: Column, key: Sequence[str], *, weights: Sequence[int] = WEIGHTS, percent: int = TOTAL_PERCENT, most_repeats: int = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """docs with columns size, pattern_words, pattern_taken, source_size, target, repeats and taken = size * repeats.

    members: array of a document's sources (elements may be null). key: columns that tell documents apart in the seeded
    order. A pattern's documents are all taken `words to take div words` times; the rest goes to documents in the order
    of a hash of the key and the seed, up to where their sum is nearest. The order is cut by slices of the hash whose sums
    are aggregated first, so only the documents of one slice in 4096 of a pattern are ever sorted together. source_size
    and target are those of the first source of the pattern. A result has mix_ before its name where docs have a column of
    that name.
    """
    names = {}
    for r in RESULTS:
        names[r] = r
        while names[r] in docs.columns:
            names[r] = f"mix_{names[r]}"
    order = seeded(seed, [F.col(k) for k in key])
    base = docs.select(F.struct(*docs.columns).alias("_row"), size.alias("size"), F.array_sort(F.array_distinct(members)).alias("_pattern"), order.alias("_hash"))
    base = base.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))
    slices = cut(base.groupBy("_pattern", "_slice").agg(F.sum("size").alias("_in")))
    patterns = cut(slices.groupBy("_pattern").agg(F.sum("_in").alias("words")))
    total = (patterns.where("size(_pattern) > 0").agg(F.sum("words")).first()[0] or 0) * percent / 100
    sources = patterns.select(F.explode("_pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words"))
    sources = cut(with_targets(ranked(sources), weights, total, most_repeats))
    table = patterns.select("_pattern", F.col("words").alias("pattern_words"))
    same = lambda a, b: a["_pattern"].eqNullSafe(b["_pattern"])
    taken = flows(patterns, sources, most_repeats)
    table = table.join(taken, same(table, taken), "left").drop(taken["_pattern"])
    firsts = sources.select("source", F.col("words").alias("source_size"), "target")
    first = F.when(F.size("_pattern") > 0, F.struct(F.element_at("_pattern", 1).alias("s")))
    table = table.withColumn("_first", first).join(firsts.withColumn("_s", F.struct(F.col("source").alias("s"))), F.col("_first").eqNullSafe(F.col("_s")), "left").drop("_first", "_s", "source")
    table = table.fillna({"pattern_taken": 0, "source_size": 0, "target": 0.0})
    table = table.withColumn("_full", F.when(F.col("pattern_words") > 0, F.expr("pattern_taken div pattern_words")).otherwise(F.lit(1)))
    table = table.withColumn("_rest", F.col("pattern_taken") - F.col("_full") * F.col("pattern_words"))
    # The rows of a slice below the one where the rest runs out are all taken; those of that slice one by one.
    upto = F.sum("_in").over(Window.partitionBy("_pattern").orderBy("_slice"))
    sums = slices.withColumn("_upto", upto)
    cuts = sums.alias("s").join(table.alias("t"), F.col("s._pattern").eqNullSafe(F.col("t._pattern"))).where("_upto > _rest")
    cuts = cuts.groupBy("s._pattern").agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_in")).alias("_before"))).alias("_cut"))
    table = table.join(cuts, same(table, cuts), "left").drop(cuts["_pattern"])
    table = cut(table.withColumns({"_at": F.coalesce(F.col("_cut._slice"), F.lit("~")), "_left": F.col("_rest") - F.coalesce(F.col("_cut._before"), F.lit(0))}).drop("_cut"))
    few = table.count() <= BROADCAST_PATTERNS
    known = base.join(F.broadcast(table) if few else table, same(base, table)).drop(table["_pattern"])
    inside = known.where("_slice = _at")
    row = Window.partitionBy("_pattern").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_more", ((F.col("_rest") > 0) & (2 * F.sum("size").over(row) - F.col("size") <= 2 * F.col("_left"))).cast("int"))
    outside = known.where("_slice <> _at").withColumn("_more", ((F.col("_rest") > 0) & (F.col("_slice") < F.col("_at"))).cast("int"))
    out = inside.unionByName(outside)
    out = out.withColumn("repeats", (F.col("_full") + F.col("_more")).cast("long"))
    out = out.withColumn("taken", F.col("size") * F.col("repeats"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], *[F.col(r).alias(names[r]) for r in RESULTS])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() for documents with one source each: doc_id, size, source_size, target, taken, repeats."""
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("_n"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    out = mix(cut(base).select("doc_id", F.col("source").alias("_s"), "_n", F.col("_text").alias("tie")), F.col("_n"), F.array("_s"), ["doc_id", "tie"], **options)
    return out.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it is repeated, with docs' columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"), word_count(F.col("text")).alias("words"), F.col("source").alias("of"))
    out = mix(rows, F.col("words"), F.array("of"), ["id", "tie"], **options)
    return out.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")
