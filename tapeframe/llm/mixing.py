"""Mixing sources to target weights, for documents that belong to one source or to several.

1. Weights share the words of the mix among the sources; a source stops at ``limit`` times its own words and what it
   can't take is shared again (``targets``).
2. Documents are added up by membership pattern (the set of their sources).  A flow network leads from the patterns,
   whose words get dearer the more often they are used (a convex cost in slices of a copy), to the sources' quotas.
   Only the arcs into patterns cost anything, so augmenting slice by slice, cheapest first, gives a largest flow of
   least cost.  Patterns that share no source are separate networks and are solved in separate tasks.
3. A pattern's words lie on a line in an order drawn from the seed and the document's key.  The flow cuts the line;
   whole documents before the cut are in the mix.  Only the stretches that hold a cut are sorted, and copies of one
   row are numbered by partition counts, so no source or repeated key meets in one task.  The cut is made RESERVE mean
   documents early, and unused documents whose sizes add up nearest to what is missing follow.

Defined results: a null text has no words; null is a source like any other and sorts last; a document without sources
takes no part in any target and gives 0 words; repeated rows are documents of their own; with no words at all every
target is 0.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.llm.components import connected
from tapeframe.llm.sharding import with_slots
from tapeframe.operators.ranking import first_per_key, global_row_number
from tapeframe.runtime import stage

WEIGHTS, SHARE, LIMIT, SEED = (5.0, 2.0, 1.0), 1.5, 2, 13
SLICES = 8  # steps of the convex cost in one copy
RESERVE = 16  # mean documents at the end of a pattern's line that are chosen by size, to meet its flow
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def token(source: Column) -> Column:
    """A name that is never null: 's' before the source's own, 'null' for the missing one."""
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: DataFrame, words_in_all: float, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sizes (token, source, size) -> plus weight, target.

    The level L of min(limit * size, L * weight) rises until the targets use ``share`` of all words: each step fixes
    the sources that are full at the level and shares the rest among the others.  A step reads one row of sums.
    """
    ranked = global_row_number(sizes, [F.col("source").isNull(), F.col("source"), F.col("token")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    known = stage(ranked.select("token", "source", "size", weight.alias("weight")), "sources")
    top, level, full = F.col("size") * float(limit), 0.0, -1
    while True:
        is_full = top <= F.lit(level) * F.col("weight")
        sums = known.agg(F.sum(F.when(is_full, top)).alias("taken"), F.sum(F.when(~is_full, F.col("weight"))).alias("open"), F.count_if(is_full).alias("full")).first()
        if sums.open is None or sums.full == full:
            break
        full, level = sums.full, max(level, (share * words_in_all - (sums.taken or 0.0)) / sums.open)
    level = level if sums.open is not None else float("inf")
    filled = F.least(top, F.lit(level) * F.col("weight")) if level != float("inf") else top
    return known.withColumn("target", filled)


class Network:
    """Largest flow by blocking flows; arcs keep their flow between calls."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.end: list[int] = []
        self.free: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.end))
            self.end.append(y)
            self.free.append(r)
        return len(self.end) - 2

    def levels(self, source: int, sink: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[source], queue = 0, deque([source])
        while queue and level[sink] < 0:
            node = queue.popleft()
            for e in self.arcs[node]:
                if self.free[e] > 0 and level[self.end[e]] < 0:
                    level[self.end[e]] = level[node] + 1
                    queue.append(self.end[e])
        return level

    def augment(self, source: int, sink: int) -> None:
        while (level := self.levels(source, sink))[sink] >= 0:
            tried = [0] * len(self.arcs)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    room = min(self.free[e] for e in path)
                    for e in path:
                        self.free[e] -= room
                        self.free[e ^ 1] += room
                    path, node = [], source
                    continue
                while tried[node] < len(self.arcs[node]):
                    e = self.arcs[node][tried[node]]
                    if self.free[e] > 0 and level[self.end[e]] == level[node] + 1:
                        break
                    tried[node] += 1
                else:
                    if node == source:
                        break
                    node = self.end[path.pop() ^ 1]
                    tried[node] += 1
                    continue
                path.append(e)
                node = self.end[e]


def route(patterns: list[tuple[list[str], int]], quotas: dict[str, int], limit: int = LIMIT, slices: int = SLICES) -> list[dict[str, int]]:
    """Words of each pattern (its sources, its size) for each source: a largest flow, evenly repeated where it can be."""
    names = sorted(quotas)
    place = {name: 1 + len(patterns) + i for i, name in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    net = Network(sink + 1)
    supply = [net.arc(0, 1 + i, 0) for i in range(len(patterns))]
    uses = [{s: net.arc(1 + i, place[s], limit * size) for s in sources if s in place} for i, (sources, size) in enumerate(patterns)]
    for name in names:
        net.arc(place[name], sink, quotas[name])
    for step in range(1, limit * slices + 1):
        for e, (_, size) in zip(supply, patterns):
            net.free[e] += size * step // slices - size * (step - 1) // slices
        net.augment(0, sink)
    return [{s: net.free[e ^ 1] for s, e in own.items() if net.free[e ^ 1]} for own in uses]


def flows(patterns: DataFrame, quotas: DataFrame, limit: int, slices: int = SLICES) -> DataFrame:
    """patterns (pattern array<string>, size), quotas (token, quota) -> pattern, token, amount, in one task per connected network."""
    links = patterns.where("size(pattern) > 1").select(F.element_at("pattern", 1).alias("a"), F.explode("pattern").alias("b"))
    roots = connected(links)
    own = quotas.join(roots.withColumnRenamed("node", "token"), "token", "left").select("token", "quota", F.coalesce("root", "token").alias("net"))
    own = stage(own, "quotas")
    first = patterns.where("size(pattern) > 0").select("pattern", "size", F.element_at("pattern", 1).alias("token"))
    parts = stage(first.join(own.select("token", "net"), "token").select("net", "pattern", "size"), "patterns")

    def solve(some: pd.DataFrame, needs: pd.DataFrame) -> pd.DataFrame:
        some = some.assign(pattern=[list(p) for p in some["pattern"]])
        listed = sorted(zip(some["pattern"], some["size"].tolist()))
        sent = route(listed, dict(zip(needs["token"], needs["quota"].tolist())), limit, slices)
        rows = [(p, s, a) for (p, _), amounts in zip(listed, sent) for s, a in sorted(amounts.items())]
        return pd.DataFrame(rows, columns=["pattern", "token", "amount"])

    return parts.groupBy("net").cogroup(own.groupBy("net")).applyInPandas(solve, "pattern array<string>, token string, amount bigint")


def lines(flow: DataFrame, patterns: DataFrame) -> DataFrame:
    """A row per pattern (size, n): whole copies of all its documents, the rest of the next copy and its early cut, and the ends of its sources' stretches."""
    sent = flow.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("token", "amount"))).alias("sent"))
    ends = F.transform(F.sequence(F.lit(1), F.size("sent")), lambda i: F.aggregate(F.slice("sent", F.lit(1), i), F.lit(0).cast("long"), lambda a, s: a + s["amount"]))
    known = patterns.join(sent, "pattern", "left").withColumn("ends", F.when(F.size("sent") > 0, ends).otherwise(F.array().cast("array<bigint>")))
    total = F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long")
    whole = F.when(F.col("size") > 0, F.floor(total / F.col("size"))).otherwise(0).cast("long")
    known = known.withColumns({"total": total, "whole": whole}).withColumn("rest", F.col("total") - F.col("whole") * F.col("size"))
    reserve = F.ceil(F.col("size") / F.col("n") * RESERVE)
    known = known.withColumn("cut", F.greatest(F.col("rest") - reserve, F.lit(0)))
    cuts = F.array_distinct(F.concat(F.array("cut"), F.transform("ends", lambda e: F.when(F.col("size") > 0, F.pmod(e, F.col("size"))).otherwise(0).cast("long"))))
    names = F.coalesce(F.col("sent.token"), F.array().cast("array<string>"))
    return known.select("pattern", "size", "whole", "rest", "cut", "ends", names.alias("names"), F.array_remove(cuts, 0).alias("cuts"))


def on_line(rows: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """Adds low and high to rows (row, pattern, key, size, draw): the words before the document on its pattern's line and up to its end.

    They are exact where a cut falls into the document's stretch; elsewhere they are the ends of the stretch, between
    which no cut lies.
    """
    stretch = F.shiftrightunsigned("draw", 64 - buckets) if buckets else F.lit(0).cast("long")
    rows = rows.withColumn("stretch", stretch)
    totals = rows.groupBy("pattern", "stretch").agg(F.sum("size").alias("width"))
    running = Window.partitionBy("pattern").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    bounds = totals.withColumn("to", F.sum("width").over(running)).withColumn("from", F.col("to") - F.col("width"))
    has_cut = F.exists("cuts", lambda c: (c > F.col("from")) & (c < F.col("to")))
    bounds = stage(bounds.join(plan.select("pattern", "cuts"), "pattern").select("pattern", "stretch", "from", "to", "cuts", has_cut.alias("has_cut")), "stretches")
    placed = rows.join(bounds.select("pattern", "stretch", "from", "to", "has_cut"), ["pattern", "stretch"])
    sorted_part = stage(placed.where("has_cut"), "cut_stretches")
    groups = sorted_part.groupBy("pattern", "stretch", "draw", "key", "size").agg(F.count("*").alias("copies"), F.min("from").alias("from"))
    order = Window.partitionBy("pattern", "stretch").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("high", F.col("from") + F.sum(F.col("size") * F.col("copies")).over(order))
    groups = groups.withColumn("low", F.col("high") - F.col("size") * F.col("copies")).join(plan.select("pattern", "cuts"), "pattern")
    split = (F.col("copies") > 1) & F.exists("cuts", lambda c: (c > F.col("low")) & (c < F.col("high")))
    groups = stage(groups.select("pattern", "stretch", "draw", F.col("key").alias("group_key"), F.col("size").alias("group_size"), "low", "high", split.alias("split"),
                                 F.xxhash64("pattern", "draw", "low").alias("group")), "groups")
    same = ["pattern", "stretch", "draw"]
    member = sorted_part.select("row", "pattern", "stretch", "draw", "key", "size").join(groups, same).where(F.col("key").eqNullSafe(F.col("group_key")) & (F.col("size") == F.col("group_size")))
    member = stage(member.drop("group_key", "group_size", "stretch", "draw"), "members")
    numbered = with_slots(member.where("split"), shard="group", slot="number")
    numbered = numbered.withColumn("low", F.col("low") + F.col("number") * F.col("size")).withColumn("high", F.col("low") + F.col("size"))
    columns = ["row", "pattern", "key", "size", "low", "high"]
    rest = placed.where("not has_cut").withColumnsRenamed({"from": "low", "to": "high"})
    return rest.select(columns).union(member.where("not split").select(columns)).union(numbered.select(columns))


def subset(sizes: dict[int, int], goal: int) -> dict[int, int]:
    """How many of each size (size: available) add up nearest to goal; the lesser sum of two equally near ones.

    Sums are bits of one long integer; sizes are added largest first until the goal itself is reached.
    """
    within = (1 << (2 * goal + 1)) - 1
    steps, sums = [], 1
    for size in sorted(sizes, reverse=True):
        left, lot = min(sizes[size], 2 * goal // size), 1
        while left and not sums >> goal & 1:
            lot = min(lot, left)
            steps.append((size, lot, sums))
            sums |= sums << (size * lot) & within
            left, lot = left - lot, 2 * lot
    below = (sums & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = sums >> (goal + 1)
    above = goal + (over & -over).bit_length() if over else 3 * goal + 1
    at, taken = (below if goal - below <= above - goal else above), {}
    for size, lot, before in reversed(steps):
        if not before >> at & 1:
            taken[size] = taken.get(size, 0) + lot
            at -= size * lot
    return taken


def filled(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """Rows (row, pattern, key, size, draw) that fill missing (pattern, missing, reached) best -> row, at (their place on the line).

    What a pattern misses is bounded by its RESERVE and one document, so sizes, sums and chosen rows are few whatever
    the number of rows; of equal sizes the first by draw are taken.
    """
    fits = rows.join(missing, "pattern").where("size > 0 and size < 2 * missing")
    counts = fits.groupBy("pattern", "missing", "size").agg(F.count("*").alias("n"))

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        taken = subset(dict(zip(own["size"].tolist(), own["n"].tolist())), int(own["missing"].iloc[0]))
        return pd.DataFrame([(own["pattern"].iloc[0], s, n) for s, n in taken.items()], columns=["pattern", "size", "take"])

    chosen = stage(counts.groupBy("pattern").applyInPandas(choose, "pattern array<string>, size bigint, take bigint"), "chosen")
    most = chosen.agg(F.max("take")).first()[0]
    if most is None:
        return rows.limit(0).select("row", F.col("size").alias("at"))
    order = [F.col("draw"), F.col("key"), F.col("row")]
    nearest = first_per_key(fits.join(chosen, ["pattern", "size"]), ["pattern", "size"], order, most)
    nearest = nearest.withColumn("n", F.row_number().over(Window.partitionBy("pattern", "size").orderBy(*order))).where("n <= take")
    run = Window.partitionBy("pattern").orderBy("size", *order).rowsBetween(Window.unboundedPreceding, 0)
    return nearest.select("row", (F.col("reached") + F.sum("size").over(run) - F.col("size")).alias("at"))


def mix(docs: DataFrame, sources: Column | None = None, key: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE, limit: int = LIMIT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, sources).

    documents: key, size, sources (array of names), copies, taken (size * copies), used_for (the source of each copy).
    sources: source, size, weight, target, taken.  ``sources`` is an array column; by default the one source of column ``source``.
    """
    spark = docs.sparkSession
    sources = F.array("source") if sources is None else sources
    member = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), token)))
    read = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("size"), member.alias("pattern"))
    rows = stage(read.withColumns({"draw": F.xxhash64("key", F.lit(seed)), "row": F.monotonically_increasing_id()}), "rows")
    patterns = stage(rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "patterns")
    everything = patterns.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("n").alias("n")).first()
    buckets = (everything.n or 0).bit_length() // 2  # a pattern's stretches and the documents in one grow alike
    name = F.when(F.col("token") != "null", F.expr("substr(token, 2)"))
    sizes = patterns.select(F.explode("pattern").alias("token"), "size").groupBy("token").agg(F.sum("size").alias("size"))
    known = stage(targets(sizes.select("token", name.alias("source"), "size"), everything.size, weights, share, limit), "targets")
    flow = flows(patterns.select("pattern", "size"), known.select("token", F.round("target").cast("long").alias("quota")), limit)
    plan = stage(lines(stage(flow, "flow"), patterns), "plan")
    placed = stage(on_line(rows, plan, buckets), "placed")
    whole = placed.join(plan.drop("size"), "pattern").withColumn("in_cut", (F.col("high") <= F.col("cut")) & (F.size("names") > 0))
    reached = whole.groupBy("pattern").agg(F.max("rest").alias("rest"), F.sum(F.when(F.col("in_cut"), F.col("size")).otherwise(0)).alias("reached"))
    missing = stage(reached.where("rest > reached").select("pattern", "reached", (F.col("rest") - F.col("reached")).alias("missing")), "missing")
    unused = whole.where(~F.col("in_cut")).select("row", "pattern", "key", "size").withColumn("draw", F.xxhash64("key", F.lit(seed)))
    extra = stage(filled(unused, missing), "extra")
    chosen = whole.join(extra, "row", "left").withColumn("copies", (F.col("whole") + F.when(F.col("in_cut") | F.col("at").isNotNull(), 1).otherwise(0)).cast("int"))
    line = F.col("line")
    own, moved = (F.col("low") + F.col("high")) / 2, F.col("at") + F.col("size") / 2
    middle = lambda i: i * line + F.when((i == F.col("whole")) & F.col("at").isNotNull(), moved).otherwise(own)
    last = F.size("names")
    used = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.get("names", F.least(F.size(F.filter("ends", lambda e: e <= middle(i))), last - 1)))
    names = lambda tokens: F.transform(tokens, lambda t: F.when(t != "null", F.substring(t, 2, 1 << 30)))
    done = chosen.join(plan.select("pattern", F.col("size").alias("line")), "pattern").withColumn("tokens", used)
    done = stage(done.select(F.col("key").alias(key), "size", names("pattern").alias("sources"), "copies", (F.col("size") * F.col("copies")).alias("taken"),
                             names("tokens").alias("used_for"), "tokens"), "mix")
    taken = done.select(F.explode("tokens").alias("token"), "size").groupBy("token").agg(F.sum("size").alias("taken"))
    summary = known.join(taken, "token", "left").select("source", "size", "weight", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return done.drop("tokens"), summary
