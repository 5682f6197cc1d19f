"""Mixing sources to target shares of the tokens.

Method: min-cost flow. Documents are summed by membership pattern (the set of a
mix's sources that hold their text). A pattern offers its tokens once for
nothing, a second time at cost 1, a third at cost 2 and so on; the flow brings
them to the sources' quotas. The total is the largest for which every source
present meets its share. Documents are then selected along a seeded order, so
that each source gets an interval of its patterns' tokens.

The order is by a hash, summed in 4096 buckets a pattern; only a bucket is ever
sorted. The driver sees one row a pattern, as arrays, however many there are.

Defined results
  * equal texts are one document, so a copy cannot get round the cap; it may
    serve every source that holds it, and counts for the source it is used for;
  * a source without documents gets nothing, the others keep their proportions,
    and the report says so;
  * null sources and texts without tokens are not selected; shares are exact to
    one document at each end of an interval.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import small_or_shuffled, staged

BUCKETS = 4096
#: Patterns whose intervals are broadcast; more are joined by a shuffle, with the same result.
MOST_PATTERNS = 100_000
#: Tokens that count as none in a flow over real capacities.
EPSILON = 1e-6


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


Patterns = dict[tuple[str, ...], int]


class Flow:
    """Maximum flow from patterns through their sources to quotas, by shortest paths.

    Patterns are columns, not nodes: a path leads from an offer over sources to a
    quota that is not met. An arc between two sources is all that patterns holding
    both can move from one to the other; a shortest path never meets a pattern twice.
    So a path fills an arc of many patterns at once, and few are needed.
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, source: np.ndarray, repeats: np.ndarray):
        """Tokens of each pattern, where its sources begin in ``source`` (and the end), how often each source may repeat."""
        self.tokens, self.first, self.source, self.sources = tokens.astype(float), first, source, len(repeats)
        self.pattern = np.repeat(np.arange(len(tokens)), np.diff(first))
        self.room = self.tokens[self.pattern] * repeats[source]
        self.most = np.maximum.reduceat(repeats[source], first[:-1])
        self.own = [np.flatnonzero(source == s) for s in range(self.sources)]
        self.start(np.zeros(self.sources), self.tokens)

    def start(self, quota: np.ndarray, offers: np.ndarray, least: float = EPSILON) -> None:
        """Nothing flows yet; ``least`` tokens count as none."""
        self.moved, self.quota, self.offers, self.least = np.zeros(len(self.source)), quota.astype(float), offers.astype(float), least

    def _sums(self, given: np.ndarray) -> np.ndarray:
        """What each source can get, if patterns have so much to give."""
        return np.bincount(self.source, np.minimum(given[self.pattern], self.room - self.moved), self.sources)

    def reached(self) -> tuple[np.ndarray, np.ndarray]:
        """The distance of each source from the offers (-1: none), and the source before it,
        as far as to the nearest source whose quota is not met."""
        far, before = np.full(self.sources, -1), np.full(self.sources, -1)
        now = np.flatnonzero(self._sums(self.offers) > self.least)
        far[now] = 0
        queue = deque(now)
        while queue:
            s = queue.popleft()
            met = far[(far >= 0) & (self.quota > self.least)]
            if far.min() >= 0 or len(met) and met.min() <= far[s]:
                break
            given = np.zeros(len(self.tokens))
            given[self.pattern[self.own[s]]] = self.moved[self.own[s]]
            for t in np.flatnonzero((self._sums(given) > self.least) & (far < 0)):
                far[t], before[t] = far[s] + 1, s
                queue.append(t)
        return far, before

    def _step(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of s and t in the patterns that hold both, and what each can move; s below 0 stands for the offers."""
        to = self.own[t]
        if s < 0:
            return to, to, np.minimum(self.offers[self.pattern[to]], self.room[to] - self.moved[to])
        at = np.full(len(self.tokens), -1)
        at[self.pattern[self.own[s]]] = self.own[s]
        to = to[at[self.pattern[to]] >= 0]
        of = at[self.pattern[to]]
        return of, to, np.minimum(self.moved[of], self.room[to] - self.moved[to])

    def run(self) -> float:
        """Push what can still be pushed; what flows already stays."""
        total = 0.0
        while True:
            far, before = self.reached()
            ends = np.flatnonzero((far >= 0) & (self.quota > self.least))
            pushed = 0.0
            for end in ends[far[ends] == far[ends].min()] if len(ends) else ():
                way, t = [], int(end)
                while t >= 0:
                    way.append((int(before[t]), t))
                    t = int(before[t])
                steps = [(s, *self._step(s, t)) for s, t in way]
                push = min(self.quota[end], *(can.sum() for *_, can in steps))
                if push <= self.least:  # an earlier path took it
                    continue
                for s, of, to, can in steps:
                    part = np.clip(push - (np.cumsum(can) - can), 0, can)
                    self.moved[to] += part
                    if s < 0:
                        self.offers[self.pattern[to]] -= part
                    else:
                        self.moved[of] -= part
                self.quota[end] -= push
                pushed += push
            if not pushed:
                return total
            total += pushed

    def largest_total(self, shares: np.ndarray) -> int:
        """The largest total for which all quotas are met.

        Where a total is too large, the least cut names sources that cannot get more
        than it lets through; the total falls to what those allow, until all is met.
        That takes at most as many flows as there are sources.
        """
        weight = shares.sum()
        if not weight:
            return 0
        every = self.tokens * self.most
        total = every.sum()
        while total > 0:
            self.start(total * shares / weight, every, max(EPSILON, 1e-12 * total))  # sums of real quotas are that exact
            if self.run() >= total * (1 - 1e-9):
                break
            far = self.reached()[0]
            short = far < 0  # all of their quotas has to come through the cut
            holds = self.offers > self.least
            holds[self.pattern[(far[self.source] >= 0) & (self.moved > self.least)]] = True
            through = every[~holds].sum() + self.room[holds[self.pattern] & short[self.source]].sum()
            less = through * weight / shares[short].sum() if short.any() else 0.0
            if not less < total:
                break
            total = less
        return int(total * (1 + 1e-12))

    def route(self, shares: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
        """Tokens moved at each place, for a total at the least cost, and the quotas.

        Only the rounds of a pattern cost something (0, 1, 2 ..), and what a pattern
        gave is never taken back. So the cheapest flow comes from a maximum flow in
        the first round, made larger in the second, and so on.
        """
        weight = shares.sum()
        quota = np.floor(total * shares / weight) if weight else np.zeros(self.sources)
        self.start(quota, self.tokens)
        self.run()
        for r in range(2, int(self.most.max(initial=1)) + 1):
            if self.quota.sum() <= EPSILON:
                break
            self.offers += np.where(self.most >= r, self.tokens, 0)
            self.run()
        return np.rint(self.moved).astype("int64"), quota.astype("int64")


def _flow(patterns: Patterns, targets: dict[str, Target]) -> tuple[Flow, np.ndarray, list, list[str]]:
    """The flow of a mix, the sources' shares, and the sorted patterns and sources."""
    keys, names = sorted(patterns), sorted(targets)
    at = {s: i for i, s in enumerate(names)}
    first = np.cumsum([0, *map(len, keys)])
    source = np.array([at[s] for p in keys for s in p], "int64")
    repeats = np.array([targets[s].repeats for s in names])
    return Flow(np.array([patterns[p] for p in keys]), first, source, repeats), np.array([targets[s].share for s in names]), keys, names


def route(patterns: Patterns, targets: dict[str, Target], total: float) -> tuple[dict, dict[str, int]]:
    """Flow of tokens (pattern, source) for a total at the least cost, and the quotas."""
    flow, shares, keys, names = _flow(patterns, targets)
    moved, quota = flow.route(shares, total)
    return dict(zip(((p, s) for p in keys for s in p), moved.tolist())), dict(zip(names, quota.tolist()))


def largest_total(patterns: Patterns, targets: dict[str, Target]) -> int:
    """The largest total for which all quotas are met."""
    flow, shares, *_ = _flow(patterns, targets)
    return flow.largest_total(shares)


def read_targets(table: DataFrame) -> dict[str, dict[str, Target]]:
    """The settings table (one row a mix and source) as a dict on the driver."""
    out: dict[str, dict[str, Target]] = {}
    for mix, source, share, repeats in table.select("mix_name", "source", "target_share", "max_repeats").collect():
        if share and share > 0 and repeats and repeats > 0:
            out.setdefault(mix, {})[source] = Target(float(share), int(repeats))
    return out


#: Which of a pattern's tokens each of its sources gets; one row a pattern.
INTERVALS = pa.schema(
    [
        ("mix_name", pa.string()), ("pattern", pa.string()), ("tokens", pa.int64()),
        ("parts", pa.list_(pa.struct([("source", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _intervals(mix: str, targets: dict[str, Target], sums: pa.Table, total: int | None) -> pa.Table:
    """INTERVALS of a mix from its patterns' sums."""
    if not sums.num_rows:
        return INTERVALS.empty_table()
    sums = sums.sort_by("pattern").combine_chunks()
    held = pc.split_pattern(sums["pattern"].combine_chunks(), "\x1f")
    first = held.offsets.to_numpy().astype("int64")
    names = sorted(held.values.unique().to_pylist())
    source = pc.index_in(held.values, pa.array(names)).to_numpy().astype("int64")
    flow = Flow(sums["tokens"].to_numpy(), first, source, np.array([targets[s].repeats for s in names]))
    shares = np.array([targets[s].share for s in names])
    moved, _ = flow.route(shares, total or flow.largest_total(shares))
    before = np.concatenate([[0], np.cumsum(moved)])
    base = before[first[:-1]][flow.pattern]
    parts = pa.StructArray.from_arrays([held.values, pa.array(before[:-1] - base), pa.array(before[1:] - base)], ["source", "begin", "end"])
    columns = [pa.repeat(mix, sums.num_rows).cast(pa.string()), sums["pattern"], sums["tokens"], pa.ListArray.from_arrays(held.offsets, parts)]
    return pa.table(columns, schema=INTERVALS)


def _pattern(held: str):
    return F.array_join(F.transform(held, lambda x: x["source"]), "\x1f")


def select_documents(
    documents: DataFrame, targets: dict[str, dict[str, Target]], seed: int = 0, total_tokens: int | None = None, most_patterns: int = MOST_PATTERNS
) -> DataFrame:
    """Selection (mix_name, source, doc_id, uses, n_tokens) from a stored table
    (doc_id, source, text_key, n_tokens)."""
    spark = documents.sparkSession
    listed = [(m, s, t.repeats) for m, own in targets.items() for s, t in own.items()]
    wanted = F.broadcast(spark.createDataFrame(listed or [(None, None, None)], "mix_name string, source string, repeats long"))
    held = documents.filter("n_tokens > 0 AND source IS NOT NULL").join(wanted, "source")
    # one row a mix and text: its sources there, each with the least id of its copies
    texts = staged(
        held.groupBy("mix_name", "text_key", "source")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"))
        .groupBy("mix_name", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("held"), F.min("n_tokens").alias("n_tokens"))
        .withColumn("pattern", _pattern("held"))
        .withColumn("place", F.xxhash64("text_key", F.lit(seed), "mix_name"))
        .withColumn("bucket", F.pmod(F.col("place"), F.lit(BUCKETS)))
    )
    sums = staged(texts.groupBy("mix_name", "pattern").agg(F.sum("n_tokens").alias("tokens")))
    intervals = [_intervals(mix, own, sums.filter(F.col("mix_name") == mix).select("pattern", "tokens").toArrow(), total_tokens) for mix, own in targets.items()]
    plan = spark.createDataFrame(pa.concat_tables([INTERVALS.empty_table(), *intervals]))
    buckets = texts.groupBy("mix_name", "pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = buckets.select(
        "mix_name", "pattern", "bucket",
        (F.sum("n").over(Window.partitionBy("mix_name", "pattern").orderBy("bucket")) - F.col("n")).alias("before"),
    ).join(small_or_shuffled(plan, most_patterns), ["mix_name", "pattern"])
    inside = Window.partitionBy("mix_name", "pattern", "bucket").orderBy("place", "text_key")
    placed = (
        texts.join(before, ["mix_name", "pattern", "bucket"])
        .withColumn("x", F.col("before") + F.sum("n_tokens").over(inside) - F.expr("n_tokens - n_tokens div 2"))
    )
    # a document whose middle is at x serves a source in every round r with begin <= x + r * tokens < end
    rounds = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("x")) / F.col("tokens")))
    return (
        placed.withColumn("part", F.explode("parts"))
        .select("mix_name", "held", "n_tokens", "tokens", "x", "part.*")
        .withColumn("uses", (rounds("end") - rounds("begin")).cast("long"))
        .filter("uses > 0")
        .withColumn("own", F.expr("filter(held, h -> h.source = source)[0].doc_id"))
        .select("mix_name", "source", F.col("own").alias("doc_id"), "uses", "n_tokens")
    )


def share_report(selected: DataFrame, targets: dict[str, dict[str, Target]]) -> DataFrame:
    """One row a mix and source: target_share, tokens, share, documents, most_uses, max_repeats."""
    spark = selected.sparkSession
    listed = [(m, s, t.share, t.repeats) for m, own in targets.items() for s, t in own.items()]
    wanted = spark.createDataFrame(listed, "mix_name string, source string, target_share double, max_repeats long")
    got = selected.groupBy("mix_name", "source").agg(
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses")
    )
    whole = Window.partitionBy("mix_name")
    return (
        wanted.join(got, ["mix_name", "source"], "left")
        .na.fill(0, ["tokens", "documents", "most_uses"])
        .withColumn("share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(whole)), F.lit(0.0)))
        .select("mix_name", "source", "target_share", "share", "tokens", "documents", "most_uses", "max_repeats")
    )
