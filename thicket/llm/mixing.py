"""Mixing sources to target weights (problem 7).

Method: documents are aggregated by membership pattern (the set of listed sources a document
counts for) to token sums; a min-cost flow routes each pattern's tokens to source quotas, where
the n-th use of a pattern's documents costs n; then documents are selected in a seeded order
until each flow is met. Only the pattern table reaches the driver. It has one row per distinct
set of sources, not per document, and its size is checked against ``MAX_PATTERNS`` and ``MAX_NAMES``.

The documents of a pattern stand in one seeded order, which is gone through again and again; the flows
to its sources are intervals of it, one after the other. So a document that counts for two sources is
used twice only if all of its pattern are used already.

Defined results. Sources compare without letter case and blanks at the ends; documents whose
source is null or isn't listed take no part. Null and empty texts have no tokens and are never
used. A source is short if the flow, which routes as many tokens as can be, leaves its quota unfilled; quotas
are shares of the total, rounded up. Repeated target rows of a source count once (largest weight and repeats); null or
non-positive weights are a target of nothing, and null repeats mean one use. Without documents
every source with a positive weight is short of nothing, but still listed with shares of zero.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from thicket.llm.tokens import RANKS, count_tokens

#: Most distinct source sets that the flow is solved for on the driver.
MAX_PATTERNS = 20_000
#: Most names of sources that these sets have together.
MAX_NAMES = 1_000_000
#: Uses of a pattern that have an arc each; further ones share arcs of doubling width, at their mean cost.
SINGLE = 64
#: Parts that a pattern's documents are summed in, by their place in the seeded order.
BINS = 4096


def source_form(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+\z", ""))


def route(patterns: dict[frozenset[str], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[frozenset[str], str], int]:
    """Min-cost flow of tokens from patterns to sources.

    The n-th use of a pattern for a source has the capacity of the pattern's tokens and costs n,
    so repetition is convex: everything is used once before anything is used twice. Successive
    shortest paths over residual arcs, with potentials, on a graph of patterns and sources.
    """
    names = ["S", "T", *sorted(quotas), *sorted(patterns, key=sorted)]
    at = {n: i for i, n in enumerate(names)}
    graph: list[list[int]] = [[] for _ in names]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for u, v, x, y in ((a, b, c, w), (b, a, 0, -w)):
            graph[u].append(len(to))
            to.append(v)
            cap.append(x)
            cost.append(y)
        return len(to) - 2

    uses: dict[tuple[frozenset[str], str], list[int]] = {}
    for p, tokens in patterns.items():
        # no more uses than the quotas of its sources could take
        most = min(max((repeats[s] for s in p), default=0), -(-sum(quotas[s] for s in p) // tokens) if tokens else 0)
        n = 0
        while n < most:
            width = 1 if n < SINGLE else min(n, most - n)
            arc(at["S"], at[p], tokens * width, n + (width + 1) // 2)
            n += width
        for s in sorted(p):
            uses[p, s] = [arc(at[p], at[s], tokens * repeats[s], 0)]
    for s, q in quotas.items():
        arc(at[s], at["T"], q, 0)
    potential = [0] * len(names)
    while True:
        far, via = [float("inf")] * len(names), [-1] * len(names)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                if cap[e] > 0 and (x := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if far[1] == float("inf"):
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far)]
        path, u = [], 1
        while u:
            path.append(via[u])
            u = to[via[u] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    return {k: f for k, arcs in uses.items() if (f := sum(cap[e ^ 1] for e in arcs))}


def sized(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, sources, tokens: each document with the list of sources it counts for."""
    docs = documents.select("doc_id", F.array(source_form(F.col("source"))).alias("sources"), "text")
    return count_tokens(docs, ranks=ranks)


def targets(mix_target: DataFrame) -> DataFrame:
    """form, source, weight, repeats, share: one row a listed source."""
    t = mix_target.where("source IS NOT NULL").withColumn("form", source_form(F.col("source")))
    t = t.groupBy("form").agg(F.min("source").alias("source"), F.max(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    return t.withColumn("share", F.coalesce(F.try_divide("weight", F.sum("weight").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


class Plan:
    """What the flow decided: token sums, quotas and flows of a mix."""

    def __init__(self, docs: DataFrame, mix_target: DataFrame):
        self.spark = docs.sparkSession
        # the list of sources is given by hand; it must stay a small table
        listed = targets(mix_target).limit(MAX_PATTERNS + 1).collect()
        if len(listed) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} listed sources")
        self.listed = {r["form"]: r for r in listed}
        names = F.array(*(F.lit(n) for n in sorted(self.listed))) if self.listed else F.array().cast("array<string>")
        self.docs = docs.select("doc_id", F.array_sort(F.array_distinct(F.array_intersect("sources", names))).alias("pattern"), "tokens").where(F.size("pattern") > 0)
        sums = self.docs.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()
        if len(sums) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} different sets of sources")
        if sum(len(r["pattern"]) for r in sums) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} sources in the sets of sources")
        self.patterns = {frozenset(r["pattern"]): r["tokens"] or 0 for r in sums}
        self.total = sum(self.patterns.values())
        weights = {s: Fraction(repr(r["weight"])) for s, r in self.listed.items()}
        whole = sum(weights.values())
        self.quotas = {s: math.ceil(w / whole * self.total) if whole else 0 for s, w in weights.items()}
        self.repeats = {s: max(0, r["repeats"]) for s, r in self.listed.items()}
        self.flow = route(self.patterns, self.quotas, self.repeats)

    def short(self) -> list[str]:
        """Listed sources whose quota the flow can't fill even at all their repetitions, and those without a document."""
        routed = dict.fromkeys(self.quotas, 0)
        for (_, s), f in self.flow.items():
            routed[s] += f
        held = set().union(*self.patterns) if self.patterns else set()
        return [s for s, q in self.quotas.items() if routed[s] < q or s not in held]


def _use_rows(plan: Plan) -> DataFrame:
    """pattern, source, size, a, b: the interval of a pattern's repeated order that each source has."""
    rows, at = [], {}
    for (p, s), f in sorted(plan.flow.items(), key=lambda x: (sorted(x[0][0]), x[0][1])):
        a = at.get(p, 0)
        rows.append((sorted(p), s, plan.patterns[p], a, a + f))
        at[p] = a + f
    return plan.spark.createDataFrame(rows, "pattern array<string>, source string, size long, a long, b long")


def _times(twice: Column) -> Column:
    """How often the point ``twice`` / 2 of the order lies in the interval, as the order repeats."""
    floor = lambda x, y: ((x - F.pmod(x, y)) / y).cast("long")
    up = lambda to: -floor(twice - 2 * F.col(to), 2 * F.col("size"))
    return up("b") - up("a")


def select_documents(plan: Plan, seed: int = 17) -> DataFrame:
    """doc_id, source, uses, tokens of every used document.

    Documents of a pattern are ordered by a seeded hash and used where their middle lies in an interval. Sums per
    bin of that order tell in which bins intervals end; only the documents of those bins are summed one by one.
    """
    docs = plan.docs.where("tokens > 0").withColumn("_at", F.xxhash64(F.lit(seed), "doc_id"))
    docs = docs.withColumn("_bin", F.shiftrightunsigned("_at", 52).cast("int"))
    use = _use_rows(plan)
    sums = docs.groupBy("pattern", "_bin").agg(F.sum("tokens").alias("_sum"))
    # at most BINS rows a pattern: the sums, not the documents, are gathered here
    before = F.sum("_sum").over(Window.partitionBy("pattern").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = sums.withColumn("_before", F.coalesce(before, F.lit(0)))
    inside = lambda to: F.pmod(F.col(to), F.col("size")).between(F.col("_before") + 1, F.col("_before") + F.col("_sum") - 1)
    ends = bins.join(F.broadcast(use), "pattern").withColumn("_edge", inside("a") | inside("b")).withColumn("_uses", _times(2 * F.col("_before") + F.col("_sum")))
    ends = ends.where("_edge OR _uses > 0").select("pattern", "source", "size", "a", "b", "_bin", "_before", "_edge", "_uses")
    rows = docs.join(ends, ["pattern", "_bin"])
    whole = rows.where("NOT _edge").withColumn("uses", F.col("_uses"))
    run = Window.partitionBy("pattern", "source", "_bin").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("_edge").withColumn("uses", _times(2 * (F.col("_before") + F.sum("tokens").over(run)) - F.col("tokens")))
    return whole.unionByName(edge).where("uses > 0").select("doc_id", "source", "uses", "tokens")


def mix(documents: DataFrame, mix_target: DataFrame, seed: int = 17, ranks: str = RANKS) -> DataFrame:
    """doc_id, source, uses, tokens: the documents of the mix and how often each is used."""
    from thicket.plans.scale import cut

    return select_documents(Plan(cut(sized(documents, ranks)), mix_target), seed)


def shares(documents: DataFrame, mix_target: DataFrame, seed: int = 17, ranks: str = RANKS) -> DataFrame:
    """source, target_share, target_tokens, mixed_tokens, actual_share, documents, short of each listed source."""
    from thicket.plans.scale import cut

    plan = Plan(cut(sized(documents, ranks)), mix_target)
    got = select_documents(plan, seed).groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("mixed_tokens"), F.count("*").alias("documents"))
    short = set(plan.short())
    rows = [(s, r["source"], float(r["share"]), plan.quotas[s], s in short) for s, r in plan.listed.items()]
    listed = plan.spark.createDataFrame(rows, "form string, name string, target_share double, target_tokens long, short boolean")
    out = listed.join(got.withColumnRenamed("source", "form"), "form", "left").na.fill(0, ["mixed_tokens", "documents"])
    share = F.coalesce(F.col("mixed_tokens") / F.lit(plan.total or None), F.lit(0.0))
    return out.select(F.col("name").alias("source"), "target_share", "target_tokens", "mixed_tokens", share.alias("actual_share"), "documents", "short")


def short_sources(documents: DataFrame, mix_target: DataFrame, ranks: str = RANKS) -> DataFrame:
    """source of each listed source that cannot reach its target share."""
    plan = Plan(sized(documents, ranks), mix_target)
    return plan.spark.createDataFrame([(plan.listed[s]["source"],) for s in plan.short()], "source string")
