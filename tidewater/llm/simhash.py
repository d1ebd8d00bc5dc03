"""SimHash near-duplicates through vantage-point trees.

Two documents link when their 64-bit fingerprints differ in at most ``radius``
bits; groups are the connected components of the links.

Fingerprints are cut into ``blocks`` bit ranges (views). If two of them differ
in at most ``radius`` bits, some view differs in at most ``radius // blocks``:
each view is a Hamming space of its own, with a smaller radius. Each has a
vantage-point tree. A node sends a fingerprint to its near or far side by the
distance from a vantage point; by the triangle bound a neighbour on the far side
is at most the view's radius beyond the border, so a fingerprint that close to
the border goes to both. Any linked pair so meets in one shard (view, leaf) at
least. Three views and a radius of four bits leave one bit a view: a fingerprint
crosses about one border in six. One view would leave the full radius, where
most fingerprints cross each border.

A shard goes on as a tree in memory, by the same rule, until its leaves are
small; leaves that the view cannot split are split by the full distance. There
the full distance of each pair decides.

Depth follows the number of points, so shards hold about SHARD of them. The
trees are fitted on a bounded sample of fingerprints (TREE_SAMPLE, a stated
parameter, which bounds their depth as well): they steer the balance of the
shards, never which pairs are found. A node takes of some candidates the vantage
point whose distances spread most, and the border that fewest stand at among
those that part its sample well.

Equal fingerprints are one point. A shard yields a spanning star of each of its
linked groups, not its pairs; stars merge by large-star and small-star rounds,
each written to the shared folder.

Defined results: null text counts as empty; fewer than four words hash as one
shingle; no word gives fingerprint zero, linked like any other; repeated rows
each get a row; a null id is the smallest only in a group of nulls; an empty
table gives an empty table; extra columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.registry import register
from tidewater.operators.common import materialize, salted_join

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCKS = 3
#: Points that a shard should hold, before copies at its borders.
SHARD = 1024
#: Points that a leaf of the tree inside a shard should hold.
LEAF = 128
TREE_SAMPLE = 65536
#: Sample points that the deepest nodes need at least, on average.
_FITTED = 4
#: Vantage points tried at a node, and the share of its points that each side of
#: a border needs.
_TRIED, _SIDE = 8, 0.3
#: Shingles whose bits are unpacked in one step.
_CHUNK = 1 << 18
_FIRST = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text: A-Z lower-cased, words, ``size``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    buffer = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        pairs = zip(starts[at:to].tolist(), ends[at + size - 1:to + size - 1].tolist(), strict=True)
        h = np.fromiter((digest(buffer[a:b], SEED) for a, b in pairs), np.uint64, to - at)
        ones += _bit_counts(h)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, lowest first. Eight one-byte
    lanes are added at once, over runs short enough not to overflow."""
    lanes = np.zeros((8, 8), np.int64)
    mask = np.uint64(0x0101010101010101)
    pad = (-len(h)) % 128
    rows = np.concatenate((h, np.zeros(pad, np.uint64))).reshape(-1, 128)
    for k in range(8):
        part = ((rows >> np.uint64(k)) & mask).sum(axis=1, dtype=np.uint64)
        lanes[k] = part.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return lanes.T.reshape(64)  # bit 8 * lane + k


def fingerprints(docs: DataFrame, size: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """doc_id and fp (signed 64 bits) for every row; if ``hashed``, h too (hash
    of the text)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, size) for t in b["text"]), np.uint64, len(b))
            yield b.drop(columns="text").assign(fp=fp.view(np.int64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    if hashed:
        return docs.select("doc_id", "text", _text_hash().alias("h")).mapInPandas(run, f"doc_id {kind}, fp bigint, h bigint")
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp bigint")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def view_masks(blocks: int) -> list[int]:
    """Bit masks of ``blocks`` ranges, as even as can be."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _distance(fp: np.ndarray, vantage: np.ndarray, mask: int) -> np.ndarray:
    return np.bitwise_count((fp ^ vantage) & np.uint64(mask)).astype(np.int64)


def _border(d: np.ndarray, radius: int) -> int:
    """The distance that parts near from far: of those that leave each side its
    share, that with the fewest points so close that they go to both; the median
    where none does. Below the largest distance where there are two."""
    at = np.bincount(d)
    below = np.cumsum(at)
    if len(d) == at[-1]:
        return len(at) - 1
    middle = min(int(np.searchsorted(below, len(d) / 2)), len(at) - 2)
    fair = np.flatnonzero((below >= _SIDE * len(d)) & (below <= (1 - _SIDE) * len(d)))
    if not len(fair):
        return middle
    from_ = np.concatenate((np.zeros(radius + 1, np.int64), below))
    return int(fair[np.argmin(below[fair] - from_[fair + 1])])


def _vantage(fp: np.ndarray, mask: int, seed: int) -> np.uint64:
    """Of some points, that with the widest spread of distances."""
    tried = fp[(np.uint64(seed) + np.arange(_TRIED, dtype=np.uint64)) * _FIRST % np.uint64(len(fp))]
    spread = [float(_distance(fp, v, mask).var()) for v in tried]
    return tried[int(np.argmax(spread))]


def fit_trees(sample: np.ndarray, blocks: int, depth: int, radius: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tree for each view: vantage points and borders, in heap order."""
    trees = []
    for mask in view_masks(blocks):
        size = (1 << depth) - 1
        vantage, middle = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        at = np.zeros(len(sample), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            order = np.argsort(at, kind="stable")
            nodes, begin, count = np.unique(at[order], return_index=True, return_counts=True)
            for node, b, c in zip(nodes.tolist(), begin, count, strict=True):
                members = sample[order[b:b + c]]
                vantage[node] = _vantage(members, mask, node)
                middle[node] = _border(_distance(members, vantage[node], mask), radius)
            unseen = np.setdiff1d(np.arange(first, 2 * first + 1), nodes)
            vantage[unseen] = (unseen.astype(np.uint64) + np.uint64(1)) * _FIRST
            middle[unseen] = mask.bit_count() // 2
            at = 2 * at + 1 + (_distance(sample, vantage[at], mask) > middle[at])
        trees.append((vantage, middle))
    return trees


def route(fp: np.ndarray, mask: int, tree: tuple[np.ndarray, np.ndarray], depth: int,
          radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of a fingerprint, leaf) pairs: its own leaf and each leaf beyond
    a border that a neighbour within ``radius`` in this view could stand behind.
    Of two neighbours on both sides of a border the near one goes to the far side."""
    vantage, middle = tree
    who, at = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for _ in range(depth):
        d = _distance(fp[who], vantage[at], mask)
        near, far = d <= middle[at], d + radius > middle[at]
        who = np.concatenate((who[near], who[far]))
        at = np.concatenate((2 * at[near] + 1, 2 * at[far] + 2))
    return who, at - ((1 << depth) - 1)


def _parts(fp: np.ndarray, spaces: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """Leaves of a vantage-point tree over a shard; of each linked pair both stand
    in one of them. ``spaces`` are the (mask, radius) to split by, in turn: the
    next one where no border of the one before leaves both sides smaller."""
    stack = [(fp, 0)]
    while stack:
        part, s = stack.pop()
        if len(part) <= LEAF or s == len(spaces):
            yield part
            continue
        mask, radius = spaces[s]
        d = _distance(part, part[len(part) // 2], mask)
        border = _border(d, radius)
        near, far = part[d <= border], part[d + radius > border]
        if max(len(near), len(far)) > 0.9 * len(part):
            stack.append((part, s + 1))
        else:
            stack += [(near, s), (far, s)]


def link_shard(fp: np.ndarray, radius: int, spaces: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(member, smallest member) for each group of linked fingerprints in a shard."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for part in _parts(fp, list(spaces)):
        for a, b in _walk(part, radius):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _walk(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for one leaf. Points without a neighbour go first, in blocks of
    distances; the rest is walked breadth first, so a dense group is met once,
    not in pairs."""
    n = len(fp)
    linked = np.zeros(n, bool)
    step = max(1, (1 << 20) // max(n, 1))
    for a in range(0, n, step):
        near = np.bitwise_count(fp[a:a + step, None] ^ fp[None, :]) <= radius
        linked[a:a + step] = near.sum(axis=1) > 1
    if not linked.any():
        return []
    left = np.sort(fp[linked].view(np.int64)).view(np.uint64)
    edges = []
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        group = []
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            for a in range(0, len(frontier), step):
                hit |= (np.bitwise_count(frontier[a:a + step, None] ^ left[None, :]) <= radius).any(axis=0)
            frontier, left = left[hit], left[~hit]
            group.append(frontier)
        root = int(root.astype(np.int64))
        edges += [(int(x), root) for g in group for x in g.view(np.int64)]
    return edges


def depth_for(points: int) -> int:
    """Levels of a tree over so many points; no deeper than its sample can fit."""
    return max(1, min((max(points, 1) - 1) // SHARD, TREE_SAMPLE // _FITTED - 1).bit_length())


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, depth: int | None = None) -> DataFrame:
    """Spanning edges (fp, other) of the links among distinct fingerprints."""
    spark = points.sparkSession
    depth = depth_for(points.count()) if depth is None else depth
    chosen = points.select("fp").orderBy(F.xxhash64("fp")).limit(TREE_SAMPLE).toPandas()["fp"]
    sample = chosen.to_numpy(np.int64).view(np.uint64)
    if not len(sample):
        return spark.createDataFrame([], "fp bigint, other bigint")
    masks, inner = view_masks(blocks), radius // blocks
    trees = spark.sparkContext.broadcast(fit_trees(sample, blocks, depth, inner))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for v, mask in enumerate(masks):
                who, leaf = route(fp, mask, trees.value[v], depth, inner)
                yield pd.DataFrame({"shard": leaf + (v << depth), "fp": fp[who].view(np.int64)})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.empty((0, 2), np.int64)
        for b in batches:
            rows = np.concatenate((rest, b[["shard", "fp"]].to_numpy(np.int64)))
            # the last shard of a batch may go on in the next one
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])
            rest = rows[cut:]
            yield from linked(rows[:cut])
        yield from linked(rest)

    def linked(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        edges = []
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            if len(part) > 1:
                mask = masks[int(part[0, 0]) >> depth]
                edges += link_shard(np.ascontiguousarray(part[:, 1]).view(np.uint64), radius, [(mask, inner), (_ALL, radius)])
        if edges:
            yield pd.DataFrame(edges, columns=["fp", "other"])

    shards = points.select("fp").mapInPandas(deal, "shard bigint, fp bigint")
    shards = shards.repartition("shard").sortWithinPartitions("shard")
    return shards.mapInPandas(join, "fp bigint, other bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Large-star and small-star rounds: every neighbour above a node, then every
    neighbour below it, moves to the smallest node around it. The edges end as
    one star for each component, after a number of rounds that grows with the
    logarithm of its size. Each round is cut by a written table."""
    e = materialize(edges.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
                    .filter("u > v").distinct(), "links")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = salted_join(both, low, ["u"], ["v"], null_safe=True, weight="rows").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        small = salted_join(large, least, ["u"], ["v"], null_safe=True, weight="rows").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u > v").distinct()
        e = materialize(small, "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _rooted(docs: DataFrame, radius: int, size: int, blocks: int, depth: int | None,
            hashed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows, the distinct ones (points), and the root of
    each linked point."""
    prints = materialize(fingerprints(docs, size, hashed), "fingerprints")
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "points")
    stars = components(links(points, radius, blocks, depth))
    return prints, points, stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def groups(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, blocks: int = BLOCKS,
           depth: int | None = None) -> DataFrame:
    """doc_id, fp and component (smallest id that links reach) for every row."""
    prints, points, member = _rooted(docs, radius, size, blocks, depth)
    # root of each point: its own print where it has no link
    rooted = member.join(points, member["node"] == points["fp"]).select("node", "root", "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("rows"))
    linked = salted_join(rooted.select("node", "root"), smallest, ["root"], ["node"], null_safe=True, weight="rows").select(
        F.col("node").alias("fp"), "component")
    alone = points.filter("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component"))
    out = salted_join(prints, linked.union(alone), ["fp"], ["doc_id"], how="left", null_safe=True)
    return out.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component"))


def keep_one(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, blocks: int = BLOCKS,
             depth: int | None = None) -> DataFrame:
    """One row of each group, that with the smallest id (of equal ids, the
    smallest text hash; one of them where rows repeat); the columns of ``docs``.
    Groups are told apart by their links, so ids may be null or repeat."""
    columns = docs.columns
    prints, _, member = _rooted(docs, radius, size, blocks, depth, hashed=True)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    root = F.coalesce("root", "fp")
    keep = first.join(member, first["fp"] == member["node"], "left").groupBy(root.alias("root")).agg(
        F.min("first").alias("first")).select("first.doc_id", "first.h")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").alias("_doc"), _text_hash().alias("_hash"))
    rows = packed.join(keep, packed["_doc"].eqNullSafe(keep["doc_id"]) & (packed["_hash"] == keep["h"]), "left_semi")
    rows = rows.dropDuplicates(["_doc", "_hash"])
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


@register("op6_simhash_dedup")
def op6_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    found = groups(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))
