"""Near-duplicate records: a chosen-path set similarity join.

Method: each text becomes a set of shingles and a minwise signature. Every tree
starts from one node that holds all records; a node picks two signature
positions by its own hash, and a record goes on to one child for each, named by
its minwise token there. Nodes of at most ``node_limit`` records are compared
exhaustively by sketches of the signatures; larger nodes branch further. Several
independent trees bring the recall near one: a pair of similarity 0.6 meets at
depth 3 of one of six trees with probability 0.9993. Pairs that pass the sketch
are checked exactly on their shingle sets.

The deeper a tree, the fewer pairs stay together in it. The number of trees
therefore follows the depth: records that lie in nodes below ``base_level`` are
sent through as many more trees as a pair at the threshold needs at the depth
that was reached (``extra_trees``).

Hot nodes branch before the shuffle: a counting sketch whose size follows the
collection finds heavy nodes level by level. What is still too large after the
shuffle branches in another round; at the last level it is compared block by
block, so no pair is dropped.

Defined results
  * repeated rows of one id and text count once; equal texts under different ids
    form one class and are linked without comparison;
  * null ids, null texts, texts below ``min_words`` words or without a shingle
    have no links;
  * ids that occur with several texts are linked if any of their texts is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import mix64, small_enough
from quirefold.session import staged

#: Minwise tokens of 16 bits by which nodes branch.
POSITIONS = 128
#: Bits of each minwise value that a sketch keeps: 64 values take two 64-bit planes.
#: Many short values tell pairs below the threshold apart better than few long ones.
BITS = 2
PLANES = POSITIONS * BITS // 64
SIG = np.dtype([("tokens", np.uint16, POSITIONS), ("planes", np.uint64, PLANES)])
#: Counters of the sketch of node sizes: about one for 64 node rows, within these bounds.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 20
#: Representatives whose texts are looked up by broadcast (20 bytes each).
BROADCAST_ROWS = 1_000_000
#: Pairs that a task holds back to drop repetitions, and rows that it compares at a time.
PAIR_BUFFER, ROWS = 1_000_000, 40_000
#: The lowest bits of a path: two for the kind, four for the level.
KIND_BITS, TAIL, STEP = np.uint64(3), np.uint64(63), np.uint64(4)
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 63, POSITIONS // 2, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, POSITIONS // 2, dtype=np.uint64)


@dataclass(frozen=True)
class Kind:
    """How the texts of one kind are compared."""

    name: str
    unit: str = "word"  # or "char"
    size: int = 5
    threshold: float = 0.8
    min_words: int = 0

    @property
    def least_matches(self) -> int:
        """Of the 128 two-bit values of a sketch, so many must agree: three and a half
        deviations below what a pair at the threshold has on average."""
        p = self.threshold + (1 - self.threshold) / (1 << BITS)
        return max(1, int(POSITIONS * p - 3.5 * (POSITIONS * p * (1 - p)) ** 0.5))


@dataclass(frozen=True)
class JoinPlan:
    trees: int = 6
    node_limit: int = 256
    base_level: int = 3  # down to here ``trees`` are enough
    max_level: int = 8
    missed: float = 0.025  # of the pairs exactly at the threshold, at any depth
    block: int = 4096


def together(similarity: float, depth: int) -> float:
    """The probability that a pair stays together down to a depth of one tree."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** 2
    return p


def missed(similarity: float, trees: int, base: int, depth: int, more: int = 0) -> float:
    """The share of pairs of a similarity that meet in no tree.

    Signatures agree in a binomial share of their positions, not just in the
    similarity. ``more`` trees are for the pairs that meet at the base level.
    """
    out = 0.0
    for n in range(POSITIONS + 1):
        weight = comb(POSITIONS, n) * similarity**n * (1 - similarity) ** (POSITIONS - n)
        high = (1 - together(n / POSITIONS, min(base, depth))) ** trees
        apart = 1 - together(n / POSITIONS, depth)
        out += weight * (high + (apart**trees - high) * apart**more)
    return out


def extra_trees(plan: JoinPlan, threshold: float, depth: int) -> int:
    """Trees that records below the base level need besides ``plan.trees``: as many as
    bring the missed pairs at the threshold down to ``plan.missed``, or to little
    more than what the base level misses anyway."""
    most = max(plan.missed, 1.1 * missed(threshold, plan.trees, plan.base_level, min(depth, plan.base_level)))
    more = 0
    while missed(threshold, plan.trees, plan.base_level, depth, more) > most:
        more += 1
    return more


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


def units(texts: list[str], kind: Kind, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, or the code points, of all texts together, and how many each text has."""
    if kind.unit == "word":
        words = [t.lower().split() for t in texts]
        count = np.fromiter(map(len, words), np.int64, len(words))
        if len(cache) > 1_000_000:
            cache.clear()
        get = cache.__getitem__
        return np.fromiter((h for w in words for h in map(get, w)), np.int64, int(count.sum())).view(np.uint64), count
    folded = [t.lower() for t in texts]
    count = np.fromiter(map(len, folded), np.int64, len(folded))
    return np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), count


def shingles(flat: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` units inside each text, and how many each text has."""
    if len(flat) < n:
        return np.empty(0, np.uint64), np.zeros(len(count), np.int64)
    span = len(flat) - n + 1
    h = np.zeros(span, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = mix64(h ^ flat[i : i + span])
    last = np.repeat(np.cumsum(count), count)[:span]
    keep = np.arange(span) + n <= last
    return h[keep], np.maximum(count - n + 1, 0)


def signatures(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Tokens and sketch (SIG) of each text; every count must be positive.

    Each of the 64 hash functions gives two minwise values, by its upper and its
    lower half.
    """
    out = np.empty(len(count), SIG)
    values = np.empty((POSITIONS, len(count)), np.uint32)
    start = np.r_[0, np.cumsum(count)[:-1]]
    with np.errstate(over="ignore"):
        for i in range(POSITIONS // 2):
            x = h * _MUL[i] + _ADD[i]
            for half, y in enumerate(((x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32))):
                values[i + half * (POSITIONS // 2)] = mix64(np.minimum.reduceat(y, start).astype(np.uint64)) >> np.uint64(32)
    out["tokens"] = (values & np.uint32(0xFFFF)).T
    at = 0
    for part in range(0, POSITIONS, 64):
        for bit in range(BITS):
            plane = ((values[part : part + 64] >> np.uint32(16 + bit)) & np.uint32(1)).astype(np.uint8).T
            packed = np.ascontiguousarray(np.packbits(plane, axis=1, bitorder="little"))
            out["planes"][:, at] = packed.view(np.uint64).ravel()
            at += 1
    return out


MEMBER_DDL = "kind int, id string, row_no long, rep long, sig binary"
MEMBERS = pa.schema([("kind", pa.int32()), ("id", pa.string()), ("row_no", pa.int64()), ("rep", pa.int64()), ("sig", pa.binary())])


def describe(kinds: tuple[Kind, ...]):
    """(kind, id, row_no, text) -> the record's class of equal texts and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
                for k, kind in enumerate(kinds):
                    own = [r for r in rows if r[0] == k and r[1] is not None and r[3] is not None]
                    if kind.unit != "word" and kind.min_words:
                        own = [r for r in own if len(r[3].split()) >= kind.min_words]
                    if not own:
                        continue
                    flat, size = units([r[3] for r in own], kind, cache)
                    h, count = shingles(flat, size, kind.size)
                    some = np.flatnonzero((count > 0) & (size >= (kind.min_words if kind.unit == "word" else 0)))
                    if not len(some):
                        continue
                    if len(some) < len(own):
                        h = h[np.repeat(np.isin(np.arange(len(own)), some), count)]
                    sig = signatures(h, count[some])
                    end = np.cumsum(size)
                    rep = [xxhash.xxh3_64_intdigest(flat[end[i] - size[i] : end[i]].tobytes(), seed=k) - (1 << 63) for i in some]
                    own = [own[i] for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(own), k, np.int32)),
                            pa.array([r[1] for r in own], pa.string()),
                            pa.array([r[2] for r in own], pa.int64()),
                            pa.array(rep, pa.int64()),
                            pa.array([s.tobytes() for s in sig], pa.binary()),
                        ],
                        schema=MEMBERS,
                    )

    return run


def children(path: np.ndarray, row: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two children for each (path, row): at two positions that the node chooses."""
    first = mix64(path ^ np.uint64(0xA5A5A5A5)) % np.uint64(POSITIONS)
    step = mix64(path ^ np.uint64(0x5A5A5A5A)) % np.uint64(POSITIONS - 1)
    tail = (path & TAIL) + STEP
    out = []
    for pos in (first, (first + step + np.uint64(1)) % np.uint64(POSITIONS)):
        token = tokens[row, pos.astype(np.int64)].astype(np.uint64)
        child = mix64(path ^ mix64((pos << np.uint64(32)) | token))
        out.append((child & ~TAIL) | tail)
    return np.concatenate(out), np.concatenate([row, row])


def bucket(path: np.ndarray, buckets: int) -> np.ndarray:
    return (path >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def roots(kind: np.ndarray, trees: range) -> tuple[np.ndarray, np.ndarray]:
    n = len(kind)
    tree = np.repeat(np.arange(trees.start, trees.stop, dtype=np.uint64), n)
    row = np.tile(np.arange(n), len(trees))
    k = kind.astype(np.uint64)[row]
    return (mix64(tree * (TAIL + np.uint64(1)) + k) & ~TAIL) | k, row


def walk(kind: np.ndarray, tokens: np.ndarray, trees: range, hot: list[np.ndarray], buckets: int):
    """Leaves (path, row), one pair for each level, and the nodes of the level after the last of ``hot``.

    ``hot``: for each level, the heavy buckets in order.
    """
    path, row = children(*roots(kind, trees), tokens)
    leaves = []
    for heavy in hot:
        deep = np.isin(bucket(path, buckets), heavy, kind="table")
        leaves.append((path[~deep], row[~deep]))
        path, row = children(path[deep], row[deep], tokens)
    return leaves, path, row


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = batch.column(0).to_numpy(zero_copy_only=False)
    rep = batch.column(1).to_numpy(zero_copy_only=False)
    return kind, rep, np.frombuffer(b"".join(batch.column(2).to_pylist()), SIG)


def count_nodes(trees: range, hot: list[np.ndarray], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for at in range(0, len(whole), 2048):
                kind, _, sig = _read(whole.slice(at, 2048))
                _, path, _ = walk(kind, sig["tokens"], trees, hot, buckets)
                np.add.at(total, bucket(path, buckets), 1)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"]
            )

    return run


DEEP_DDL = "kind int, rep long, level int"


def deep_records(trees: range, hot: list[np.ndarray], buckets: int, base: int):
    """(kind, rep, sig) -> the records that lie in a node below the base level, with the deepest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                kind, rep, sig = _read(whole.slice(at, 2048))
                leaves, _, row = walk(kind, sig["tokens"], trees, hot, buckets)
                level = np.zeros(len(kind), np.int32)
                for n, (_, r) in enumerate(leaves, 1):
                    level[r] = n
                level[row] = len(hot) + 1
                some = np.flatnonzero(level > base)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (kind, rep, level)], names=["kind", "rep", "level"])

    return run


NODE_DDL = "path long, rep long, " + ", ".join(f"s{i} long" for i in range(PLANES))


def _nodes(path, rep, row, planes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(path.view(np.int64)), pa.array(rep[row]), *(pa.array(planes[row, i].view(np.int64)) for i in range(PLANES))],
        names=["path", "rep", *(f"s{i}" for i in range(PLANES))],
    )


def place(trees: range, hot: list[np.ndarray], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                kind, rep, sig = _read(whole.slice(at, 2048))
                leaves, path, row = walk(kind, sig["tokens"], trees, hot, buckets)
                for p, r in [*leaves, (path, row)]:
                    if len(p):
                        yield _nodes(p, rep, r, sig["planes"])

    return run


def deepen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, rep, sig) -> the record's two children of that node."""
    for batch in batches:
        if len(batch):
            path, rep, sig = _read(batch)
            child, row = children(path.view(np.uint64), np.arange(len(path)), sig["tokens"])
            yield _nodes(child, rep, row, sig["planes"])


def level_of(path):
    """The level of a node, as a column."""
    return F.shiftright(path, 2).bitwiseAND(15).cast("int")


FOUND_DDL = "a long, b long, path long"


def node_pairs(path: np.ndarray, rep: np.ndarray, planes: list[np.ndarray], least: tuple[int, ...]) -> np.ndarray:
    """Every pair of records of one node whose sketches agree; rows lie in the order of their paths.

    Each node's rows are laid out as a ring: row i meets the rows 1, 2 .. m/2 places
    on. Larger nodes come first, so that the rows to compare at one distance are
    stretches of the same arrays.
    """
    if not len(path):
        return np.empty((2, 0), np.int64)
    first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    size = np.diff(np.r_[first, len(path)])
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 1]
    if not len(order):
        return np.empty((2, 0), np.int64)
    first, size = first[order], size[order]
    wide = size + size // 2
    node = np.repeat(np.arange(len(size)), wide)
    place = np.arange(len(node)) - np.repeat(np.cumsum(wide) - wide, wide)
    source = np.repeat(first, wide) + place % size[node]
    left = np.where(place < size[node], node, -1)
    most = np.array([POSITIONS - x for x in least], np.uint8)[(path[source] & KIND_BITS).astype(np.int64)]
    rep, planes = rep[source], [x[source] for x in planes]
    end = np.cumsum(wide)
    got = []
    for d in range(1, int(size[0]) // 2 + 1):
        n = int(end[np.searchsorted(-size, -2 * d, side="right") - 1])  # of the nodes with at least 2d rows
        apart = 0
        for i in range(0, PLANES, BITS):
            differ = planes[i][: n - d] ^ planes[i][d:n]
            for plane in planes[i + 1 : i + BITS]:
                differ |= plane[: n - d] ^ plane[d:n]
            apart = apart + np.bitwise_count(differ)
        near = apart <= most[: n - d]
        near &= left[: n - d] == node[d:n]
        near = np.flatnonzero(near)
        if len(near):
            got.append(np.stack([rep[near], rep[near + d]]))
    if not got:
        return np.empty((2, 0), np.int64)
    both = np.sort(np.concatenate(got, axis=1), axis=0)
    return both[:, both[0] != both[1]]


def distinct_pairs(both: np.ndarray) -> np.ndarray:
    """Each pair once: in the order of a hash, repetitions are neighbours."""
    key = mix64(mix64(both[0].view(np.uint64)) ^ both[1].view(np.uint64))
    order = np.argsort(key)
    both, key = both[:, order], key[order]
    new = np.r_[True, (both[:, 1:] != both[:, :-1]).any(axis=0)] if len(key) else np.zeros(0, bool)
    return both[:, new]


def compare_nodes(least: tuple[int, ...], limit: int | None):
    """Rows sorted by path -> pairs whose sketches agree; rows of nodes above the limit."""

    def found(both):
        n = both.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(both[0]), pa.array(both[1]), pa.nulls(n, pa.int64())],
            names=["a", "b", "path"],
        )

    def larger(path, rep):
        return pa.RecordBatch.from_arrays(
            [pa.array(rep), pa.nulls(len(path), pa.int64()), pa.array(path.view(np.int64))], names=["a", "b", "path"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        near: list[np.ndarray] = []  # pairs of several batches: most are found in many nodes
        rows = 0
        big = None  # the node that is being passed on

        def work(part, last: bool):
            """Compare the whole nodes of ``part``; returns what may go on in the next batch."""
            nonlocal big
            path, rep, *planes = part
            out = []
            if not len(path):
                if near:
                    out.append(found(distinct_pairs(np.concatenate(near, axis=1))))
                return out, part
            cut = len(path) if last else int(np.searchsorted(path.view(np.int64), path.view(np.int64)[-1]))
            if limit is not None:
                size = np.searchsorted(path.view(np.int64), path.view(np.int64), side="right") - np.searchsorted(path.view(np.int64), path.view(np.int64))
                over = size > limit
                if big is not None:
                    over |= path == big
                if len(path) and over[-1]:
                    big = path[-1]
                    cut = len(path)
                else:
                    big = None
                if over.any():
                    out.append(larger(path[over], rep[over]))
                here = ~over
                here[cut:] = False
            else:
                here = np.arange(len(path)) < cut
            if here.any():
                both = node_pairs(path[here], rep[here], [x[here] for x in planes], least)
                if both.shape[1]:
                    near.append(both)
            if near and (last or sum(x.shape[1] for x in near) > PAIR_BUFFER):
                out.append(found(distinct_pairs(np.concatenate(near, axis=1))))
                near.clear()
            return out, tuple(x[cut:] for x in part)

        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(PLANES + 2)]
            held.append((cols[0].view(np.uint64), cols[1], *(x.view(np.uint64) for x in cols[2:])))
            rows += len(batch)
            if rows >= ROWS:
                out, rest = work(tuple(np.concatenate(x) for x in zip(*held)), False)
                yield from out
                held, rows = [rest], 0
        if held:
            out, _ = work(tuple(np.concatenate(x) for x in zip(*held)), True)
            yield from out

    return run


def _compare(nodes: DataFrame, kinds: tuple[Kind, ...], limit: int | None) -> DataFrame:
    least = tuple(k.least_matches for k in kinds)
    return (
        nodes.repartition("path")
        .sortWithinPartitions("path")
        .mapInArrow(compare_nodes(least, limit), FOUND_DDL)
    )


def heavy_nodes(signed: DataFrame, trees: range, plan: JoinPlan, records: int) -> tuple[list[np.ndarray], int]:
    """The heavy buckets of each level that branches before the shuffle, and the number of buckets.

    The driver gets at most a quarter of the buckets, whatever the collection's size.
    """
    buckets = LEAST_BUCKETS
    while buckets < MOST_BUCKETS and buckets * 64 < records * 2 * len(trees):
        buckets *= 2
    hot: list[np.ndarray] = []
    while len(hot) < plan.max_level - 1:
        loads = staged(
            signed.mapInArrow(count_nodes(trees, hot, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        )
        total = loads.agg(F.sum("n")).first()[0] or 0
        heavy = [r[0] for r in loads.filter(F.col("n") > max(plan.node_limit, 4 * total // buckets)).select("bucket").collect()]
        if not heavy:
            break
        hot.append(np.array(sorted(heavy), np.int64))
    return hot, buckets


def tree_pairs(signed: DataFrame, kinds: tuple[Kind, ...], plan: JoinPlan, trees: range, records: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs (a, b) of some trees; the records in nodes below the base level: kind, rep, level)."""
    hot, buckets = heavy_nodes(signed, trees, plan, records)
    nodes = signed.mapInArrow(place(trees, hot, buckets), NODE_DDL)
    deep = signed.mapInArrow(deep_records(trees, hot, buckets, plan.base_level), DEEP_DDL) if len(hot) >= plan.base_level else None
    pairs = None
    for _ in range(plan.max_level + 1):
        found = staged(_compare(nodes, kinds, plan.node_limit))
        own = found.filter("path IS NULL").select("a", "b")
        rest = found.filter("path IS NOT NULL").select("path", level_of(F.col("path")).alias("level"), F.col("a").alias("rep"))
        more = rest.filter(F.col("level") < plan.max_level)
        done = rest.filter(F.col("level") >= plan.max_level)
        if not done.isEmpty():
            own = own.unionByName(_blocks(done, signed, kinds, plan))
        pairs = own if pairs is None else pairs.unionByName(own)
        if more.isEmpty():
            break
        below = (
            more.filter(F.col("level") >= plan.base_level).groupBy("rep").agg((F.max("level") + 1).alias("level"))
            .join(signed.select("kind", "rep"), "rep").select("kind", "rep", "level")
        )
        deep = below if deep is None else deep.unionByName(below)
        nodes = more.join(signed, "rep").select("path", "rep", "sig").mapInArrow(deepen, NODE_DDL)
    return pairs, deep


def candidate_pairs(reps: DataFrame, kinds: tuple[Kind, ...], plan: JoinPlan) -> DataFrame:
    """Distinct pairs (a, b) of class representatives whose sketches agree in some node."""
    signed = reps.select("kind", "rep", "sig")
    pairs, deep = tree_pairs(signed, kinds, plan, range(plan.trees), signed.count())
    if deep is not None:
        deep = staged(deep)
        depth = {r[0]: r[1] for r in deep.groupBy("kind").agg(F.max("level")).collect()}  # one row a kind
        extra = {k: n for k, d in depth.items() if (n := extra_trees(plan, kinds[k].threshold, d))}
        if extra:
            some = deep.filter(F.col("kind").isin(*extra)).select("kind", "rep").distinct()
            again = staged(signed.join(some, ["kind", "rep"], "left_semi").select("kind", "rep", "sig"))
            more, _ = tree_pairs(again, kinds, plan, range(plan.trees, plan.trees + max(extra.values())), again.count())
            pairs = pairs.unionByName(more)
    return pairs.distinct()


def _blocks(done: DataFrame, signed: DataFrame, kinds: tuple[Kind, ...], plan: JoinPlan) -> DataFrame:
    """Nodes still too large at the last level: all pairs, one pair of blocks at a time."""
    sizes = done.groupBy("path").agg(F.ceil(F.count("*") / plan.block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    rows = (
        done.join(sizes, "path")
        .join(signed, "rep")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("key", F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")))
        # the lowest bits keep kind and level
        .withColumn("path", F.col("key").bitwiseAND(F.lit(-64)).bitwiseOR(F.col("path").bitwiseAND(F.lit(63))))
    )

    def run(batches):
        for batch in batches:
            if len(batch):
                path, rep, sig = _read(batch)
                yield _nodes(path.view(np.uint64), rep, np.arange(len(path)), sig["planes"])

    nodes = rows.select("path", "rep", "sig").mapInArrow(run, NODE_DDL)
    return _compare(nodes, kinds, None).select("a", "b")


def shingle_sets(kinds: tuple[Kind, ...]):
    """(kind, rep, text) -> (kind, rep, set of shingle hashes)."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            sets = []
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                h, _ = shingles(*units([text], kinds[kind], cache), kinds[kind].size)
                sets.append(np.unique(h).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], names=["kind", "rep", "items"])

    return run


@dataclass
class Links:
    """members: kind, id, rep (distinct); pairs: kind, a, b of different texts."""

    members: DataFrame
    pairs: DataFrame


def similar_records(rows: DataFrame, kinds: tuple[Kind, ...], plan: JoinPlan | None = None) -> Links:
    """Links between the records (kind: index into ``kinds``, id, row_no, text)."""
    plan = plan or JoinPlan()
    rows = rows.select(F.col("kind").cast("int").alias("kind"), F.col("id").cast("string").alias("id"), F.col("row_no").cast("long").alias("row_no"), "text")
    described = staged(rows.mapInArrow(describe(kinds), MEMBER_DDL))
    # which rows repeat a text is found on the keys alone; signatures are not shuffled for it
    keys = described.select("kind", "rep", "row_no")
    several = keys.groupBy("kind", "rep").agg(F.min("row_no").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = staged(keys.join(several, ["kind", "rep"]).filter("row_no > first").select("kind", "rep", "row_no"))
    hint = F.broadcast if small_enough(later, BROADCAST_ROWS) else (lambda x: x)
    reps = staged(described.join(hint(later), ["kind", "rep", "row_no"], "left_anti").select("kind", "rep", "row_no", "sig"))
    pairs = staged(candidate_pairs(reps, kinds, plan))
    named = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = staged(reps.select("kind", "rep", "row_no").join(named, "rep", "left_semi"))
    # with few representatives to look up, their texts are filtered where they are read
    hint = F.broadcast if small_enough(wanted, BROADCAST_ROWS) else (lambda x: x)
    texts = rows.select("kind", "row_no", "text").join(hint(wanted), ["kind", "row_no"]).select("kind", "rep", "text")
    sets = staged(texts.mapInArrow(shingle_sets(kinds), "kind int, rep long, items array<long>").dropDuplicates(["rep"]))
    threshold = F.element_at(F.array(*(F.lit(k.threshold) for k in kinds)), F.col("kind") + 1)
    a = sets.select("kind", F.col("rep").alias("a"), F.col("items").alias("xs"))
    b = sets.select(F.col("rep").alias("b"), F.col("items").alias("ys"))
    checked = (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("both", F.size(F.array_intersect("xs", "ys")))
        .withColumn("j", F.col("both") / (F.size("xs") + F.size("ys") - F.col("both")))
        .filter(F.col("j") >= threshold)
        .select("kind", "a", "b")
    )
    members = staged(described.select("kind", "id", "rep").distinct())
    return Links(members, staged(checked))


#: Ids of one text that a task of ``id_pairs`` joins with all the others.
COPIES = 1000


def id_pairs(links: Links) -> DataFrame:
    """Every linked pair of different ids (kind, id_a < id_b), each once.

    The copies of one text are n * (n - 1) / 2 of these pairs; ``classes`` is the
    form without them. A large group of copies is spread over many tasks.
    """
    m = links.members
    left, right = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.pairs.join(left, "a").join(right, "b").select("kind", "x", "y")
    copies = m.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = m.join(copies, "rep")
    one = same.select("kind", "rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    all_ = same.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = one.join(all_, ["rep", "part"]).filter("x < y").select("kind", "x", "y")
    return (
        across.unionByName(within)
        .filter("x <> y")
        .select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node reachable, by alternating large and small stars.

    ``edges`` has long columns a, b. Each round is two grouped minima; nothing is
    collected, and the rounds grow with the logarithm of the longest chain.
    """
    links = staged(edges.select("a", "b").filter("a <> b").distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("class"))
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = staged(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        links = staged(
            down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("class")).union(
        links.select(F.col("b"), F.col("b"))
    ).distinct()


def classes(links: Links) -> DataFrame:
    """One row per id: kind, id, class_id (the least id of its class), class_size, links."""
    m = links.members
    copies = m.groupBy("rep").agg(F.count("*").alias("n"))
    near = links.pairs.select("a", "b").union(links.pairs.select(F.col("b"), F.col("a")))
    beyond = near.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("beyond"))
    group = components(links.pairs).select(F.col("node").alias("rep"), F.col("class").alias("root"))
    rows = (
        m.join(copies, "rep")
        .join(beyond, "rep", "left")
        .join(group, "rep", "left")
        .select(
            "kind", "id", F.coalesce("root", "rep").alias("root"),
            (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"),
        )
    )
    head = rows.groupBy("kind", "root").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("class_size"))
    return (
        rows.join(head, ["kind", "root"])
        .groupBy("kind", "id")
        .agg(F.min("class_id").alias("class_id"), F.max("class_size").alias("class_size"), F.sum("links").alias("links"))
    )
