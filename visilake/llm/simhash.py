"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A document's fingerprint has a bit set where over half of its word shingles' 64-bit hashes have
it; documents link at ``radius`` or fewer differing bits, and a component is what links reach.

Equal fingerprints meet first, so that a group of copies is one point however large it is. A
vantage-point tree, grown on a bounded sample of points, deals all points into shards: at each
node a point goes inside (distance to the vantage point at most the node's bound) or outside,
and as a query it also visits the other side where the triangle inequality allows a link across
the bound. So every pair within the radius meets in some shard. A shard's task prunes with a
tree of its own, compares the rest exactly, and returns the links of a spanning forest, so a
dense group costs as many rows as it has points. Components come from alternating large-star
and small-star steps; links, points and components never reach the driver.

With ``keys``, points also carry the least of their shingles' hashes under several permutations,
and only points that share one are compared: texts of similarity s share one of k with probability
1 - (1 - s)^k. Then even a radius at which no tree prunes costs as many rows as points.

``similar_groups`` takes fingerprints, of the sets of shingles, as a filter only. A first pass over
the shards finds the points that take part in some pair within the bounds; their texts alone are
then dealt to the shards, and a pair links where the sets themselves are as similar as asked. A pair
is compared under the first key it shares, and not at all once its points are joined.

Null and empty texts have fingerprint zero and link like any other. Rows of equal id are separate
rows; a null id never becomes a component's id unless all its rows have none. Visits multiply
with the depth of the tree by about 1.4 a level at radius 2, so work grows a little under n^1.5. Very
long texts are read whole. An empty table gives no rows; columns of other names play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import give_back, stored, whole_text, worker_tables

SEED = 42
SAMPLE = 20_000
SHARD_POINTS = 4096
LEAF_POINTS = 256
SLICE_SHINGLES = 1 << 15
SLICE_MEMBERS = 1 << 20
#: pairs a shard compares at a time
SLICE_PAIRS = 1 << 18
FILTER_BITS = 1 << 24
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; white space is ASCII, A-Z are folded."""
    tokens = text.encode("utf-8").translate(FOLD).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash derived from a hash; the 0th is the hash itself."""
    if not i:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many hashes set each bit, highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), SLICE_SHINGLES):
        bits = np.unpackbits(h[at : at + SLICE_SHINGLES].astype(">u8").view(np.uint8)).reshape(-1, 64)
        for part in np.array_split(bits, max(1, len(bits) // 255 + 1)):
            total += part.sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(hashes: np.ndarray, blocks: int = 1) -> list[int]:
    """``blocks`` 64-bit fingerprints, as signed integers; zeros if there are no shingles."""
    found = []
    for i in range(blocks):
        over = 2 * _set_bits(_mixed(hashes, i)) > len(hashes)
        found.append(int(np.packbits(over).view(">i8")[0]))
    return found


def least_hashes(hashes: np.ndarray, keys: int) -> list[int]:
    """The least shingle hash under each of ``keys`` permutations; one each for no shingles."""
    return [int(_mixed(hashes, 100 + i).min(initial=(1 << 64) - 1).astype(np.uint64).view(np.int64)) for i in range(keys)]


def fingerprints(docs: DataFrame, words: int = 3, blocks: int = 1, keys: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print: array of ``blocks`` longs, keys: array of ``keys`` longs), one row per document."""

    @F.pandas_udf("struct<print array<long>, keys array<long>>")
    def make(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            h = shingle_hashes(t, words)
            rows.append((fingerprint(h, blocks), least_hashes(h, keys)))
        return pd.DataFrame(rows, columns=["print", "keys"])

    return docs.select(F.col(doc_id).alias("doc_id"), make(whole_text(text)).alias("_p")).select("doc_id", "_p.print", "_p.keys")


def set_fingerprints(docs: DataFrame, words: int, blocks: int, keys: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, print, keys) of every document's set of shingles; ``node`` names the set."""

    @F.pandas_udf("struct<node long, print array<long>, keys array<long>>")
    def make(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_tables()
        for column in columns:
            rows = []
            for t in column:
                h = np.unique(shingle_hashes(t, words))
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)[0]
                rows.append((node, fingerprint(h, blocks), least_hashes(h, keys)))
            yield pd.DataFrame(rows, columns=["node", "print", "keys"])
        give_back()

    return docs.select(F.col(doc_id).alias("doc_id"), make(whole_text(text)).alias("_p")).select("doc_id", "_p.node", "_p.print", "_p.keys")


# --- vantage-point trees: a node is (vantage point, bound, inside, outside), a leaf its number


def _longs(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of equal length, a row each."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).view(np.uint64)


def distances(points: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def grow(points: np.ndarray, depth: int, leaf: int = 1, prune: int | None = None, first: int = 0):
    """(tree, number of its leaves); with ``prune``, no split that most points would cross anyway."""
    if depth <= 0 or len(points) <= leaf:
        return first, 1
    trials = points[:: max(1, len(points) // 5)][:5]
    vantage = max(trials, key=lambda v: (float(distances(points, v).std()), int(v)))
    d = distances(points, vantage)
    bound = int(np.median(d))
    if (d <= bound).all():
        bound = int(d.max()) - 1
    inside = d <= bound
    if not inside.any() or prune is not None and (np.abs(d - bound) <= prune).mean() > 0.8:
        return first, 1
    left, n = grow(points[inside], depth - 1, leaf, prune, first)
    right, m = grow(points[~inside], depth - 1, leaf, prune, first + n)
    return (vantage, bound, left, right), n + m


def _first_leaf(node) -> int:
    while isinstance(node, tuple):
        node = node[2]
    return node


def visits(tree, points: np.ndarray, radius: int, depth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, point's place, at home): every leaf that may hold a point within the radius.

    With ``depth``, a point goes no deeper than its own; a node where it stops counts as a leaf.
    """
    found, stack = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))], [(tree, 0, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, level, at, home = stack.pop()
        stop = np.full(len(at), not isinstance(node, tuple)) if depth is None else (depth[at] <= level) | (not isinstance(node, tuple))
        if stop.any():
            found.append((np.full(int(stop.sum()), _first_leaf(node)), at[stop], home[stop]))
            at, home = at[~stop], home[~stop]
        if len(at):
            vantage, bound, left, right = node
            d = distances(points[at], vantage)
            for side, own, reach in ((left, d <= bound, d <= bound + radius), (right, d > bound, d > bound - radius)):
                stack.append((side, level + 1, at[reach], (home & own)[reach]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pairs(points: np.ndarray, more: np.ndarray, home: np.ndarray, radius: int, total: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the bounds in which a home point takes part, some in both orders, in parts."""
    own = np.flatnonzero(home)
    tree, _ = grow(points[own], 64, LEAF_POINTS, radius)
    leaf, at, stays = visits(tree, points, radius)
    order = np.argsort(leaf, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        here, asked = at[part[stays[part] & home[at[part]]]], at[part]
        if not len(here):
            continue
        step = max(1, SLICE_PAIRS // len(here))
        for k in range(0, len(asked), step):
            q = asked[k : k + step]
            i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[here][None, :]) <= radius)
            a, b = q[i], here[j]
            if total is not None:
                near = np.bitwise_count(points[a] ^ points[b]).astype(np.int32) + np.bitwise_count(more[a] ^ more[b]).sum(axis=1, dtype=np.int32) <= total
                a, b = a[near], b[near]
            yield a, b


def _forest(points: np.ndarray, more: np.ndarray, home: np.ndarray, radius: int, total: int | None) -> np.ndarray:
    """Each point's root among those it links to, over links in which a home point takes part."""
    root = np.arange(len(points))
    for a, b in _pairs(points, more, home, radius, total):
        a, b = root[a], root[b]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
        for x, y in pairs.tolist():
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while len(pairs) and (root[root] != root).any():
            root = root[root]
    return root


def _first_met(pairs: Iterator[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair once, without those that share one of ``keys``, the keys before the shard's own."""
    for a, b in pairs:
        once = (a < b) | (a > b) & ~home[a]  # two home points come in both orders
        a, b = a[once], b[once]
        new = ~(keys[a] == keys[b]).any(axis=1)
        yield a[new], b[new]


def _similar_forest(sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: tuple[int, int]) -> np.ndarray:
    """Each point's root over those pairs whose sets have a similarity of ``least`` (a fraction) or more."""
    root = np.arange(len(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(size) - size
    names, member = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    held = np.zeros(len(names), bool)
    over, under = least
    for a, b in pairs:
        fit = under * np.minimum(size[a], size[b]) >= over * np.maximum(size[a], size[b])
        a, b = a[fit], b[fit]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for i, others in zip(a[np.flatnonzero(np.diff(a, prepend=-1))].tolist(), np.split(b, np.flatnonzero(np.diff(a)) + 1), strict=False):
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            own = member[first[i] : first[i] + size[i]]
            held[own] = True
            for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(size[others]) // SLICE_MEMBERS)) + 1):
                ends = np.cumsum(size[part])
                at = np.arange(ends[-1]) + np.repeat(first[part] - ends + size[part], size[part])
                shared = np.add.reduceat(held[member[at]], ends - size[part], dtype=np.int64)
                alike = part[under * shared >= over * (size[i] + size[part] - shared)]
                if len(alike):
                    joined = np.unique(root[np.append(alike, i)])
                    root[np.isin(root, joined)] = joined[0]
            held[own] = False
    return root


def _dealt(points: DataFrame, radius: int, shard_points: int, more: bool) -> DataFrame:
    """(shard, home, node, print) of the shards in which pairs meet; with ``more``, turn (the number of
    the shard's key) and keys too. No rows at all if there are no points."""
    spark = points.sparkSession
    n = points.count()
    extra = ["turn", "keys"] if more else []
    schema = "shard long, home boolean, node long, print array<long>" + (", turn int, keys array<long>" if more else "")
    if not n:
        return spark.createDataFrame([], schema)
    words, keys = points.select(F.size("print"), F.size("keys")).first()
    carried = ["node", "print", *(["keys"] if more else [])]
    keyed = points.select(*carried, F.posexplode("keys").alias("i", "key")) if keys else points.select(*carried, F.lit(0).alias("i"), F.lit(0).cast("long").alias("key"))
    keyed = keyed.select(*carried, F.col("i").alias("turn"), (F.xxhash64("i", "key") if keys else F.lit(0).cast("long")).alias("key"))
    if keys:
        # a key of one point has no pair to find; one of more points than a shard is divided
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("points")).where("points > 1")
        keyed = keyed.join(sizes, "key").withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("points") / shard_points))).cast("int"))
        most = sizes.agg(F.max("points")).first()[0] or 0
    else:
        most = n
        keyed = keyed.withColumn("depth", F.lit(max(0, math.ceil(math.log2(n / shard_points)))))
    share = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)
    sample = np.array(sorted(r[0] for r in points.where(share).select(F.col("print")[0]).collect()), np.int64).view(np.uint64) if most > shard_points else np.empty(0, np.uint64)
    tree, _ = grow(sample, max(0, math.ceil(math.log2(max(1, most) / shard_points))))
    arrow = pa.schema([("shard", pa.int64()), ("home", pa.bool_()), ("node", pa.int64()), ("print", pa.list_(pa.int64())), *([("turn", pa.int32()), ("keys", pa.list_(pa.int64()))] if more else [])])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                prints = batch.column("print").flatten().to_numpy(zero_copy_only=False).reshape(-1, words).view(np.uint64)
                leaf, place, home = visits(tree, prints[:, 0], radius, batch.column("depth").to_numpy(zero_copy_only=False))
                own = np.empty(batch.num_rows, np.int64)
                own[place[home]] = leaf[home]
                later = home | (leaf > own[place])  # a pair meets in the later leaf only
                key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[place[later]]
                shard = _mixed(key + leaf[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1).view(np.int64)
                rows = batch.select(["node", "print", *extra]).take(pa.array(place[later]))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home[later]), *rows.columns], schema=arrow)
    return keyed.select("node", "print", "key", "depth", *extra).mapInArrow(deal, schema)


def links(points: DataFrame, radius: int, total: int | None = None, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b): nodes of a spanning forest of all pairs within the radius.

    ``points`` holds one row per node: node, print (first word: the radius counts its bits) and
    keys. ``total`` bounds the differing bits of all words together. Points with keys are compared
    where they share one; without keys, all are. A key (or the whole) is divided by the tree as
    deep as its number of points asks for, counted before points move.
    """
    def compare(table: pa.Table) -> pa.Table:
        prints = _longs(table, "print")
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        node = table.column("node").to_numpy()
        order = np.lexsort((node, ~home))  # the same forest whatever order rows arrive in
        prints, home, node = prints[order], home[order], node[order]
        root = _forest(np.ascontiguousarray(prints[:, 0]), prints[:, 1:], home, radius, total) if home.any() else np.arange(len(node))
        far = root != np.arange(len(root))
        return pa.table({"a": node[far], "b": node[root[far]]})

    return _dealt(points, radius, shard_points, False).groupBy("shard").applyInArrow(compare, "a long, b long")


def similar_links(points: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, radius: int, total: int, least: tuple[int, int], shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b): nodes of a spanning forest of all pairs that share a key, are within the bounds and whose
    sets of ``words``-word shingles have a similarity of ``least`` (a fraction) or more.

    ``texts`` adds the text of its node to each row of a table.
    """
    schema = "shard long, home boolean, node long, print array<long>, turn int, keys array<long>"

    def bounded(table: pa.Table) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        prints, home = _longs(table, "print"), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        before = _longs(table, "keys")[:, : table.column("turn")[0].as_py()]
        return home, _first_met(_pairs(np.ascontiguousarray(prints[:, 0]), prints[:, 1:], home, radius, total), before, home) if home.any() else iter(())

    def meet(table: pa.Table) -> pa.Table:
        worker_tables()
        home, pairs = bounded(table)
        seen = np.zeros(len(home), bool)
        for a, b in pairs:
            seen[a] = seen[b] = True
        return table.filter(pa.array(seen))

    def verify(table: pa.Table) -> pa.Table:
        worker_tables()
        table = table.sort_by([("home", "descending"), ("node", "ascending")])  # the same forest whatever order rows arrive in
        sets = [np.unique(shingle_hashes(t, words)) for t in table.column("text").to_pylist()]
        root, node = _similar_forest(sets, bounded(table)[1], least), table.column("node").to_numpy()
        far = root != np.arange(len(root))
        return pa.table({"a": node[far], "b": node[root[far]]})

    met = stored(_dealt(points, radius, shard_points, True).groupBy("shard").applyInArrow(meet, schema), "met")
    return texts(met).groupBy("shard").applyInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for nodes that have a link."""
    edges, before = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.where("a <> b").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def group(prints: DataFrame, radius: int, total: int | None = None, shard_points: int = SHARD_POINTS) -> DataFrame:
    """``prints`` (doc_id, print, keys) with ``component_id``: the smallest id reachable."""
    node = F.col("print")[0] if total is None else F.xxhash64("print")
    rows = prints.withColumn("node", node)
    points = _points_of(rows)
    return _named(rows, points, links(points, radius, total, shard_points)).drop("node")


def _points_of(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("node").agg(F.any_value("print").alias("print"), F.any_value("keys").alias("keys"), F.min("doc_id").alias("least")), "points")


def _named(rows: DataFrame, points: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the smallest id that links reach."""
    rooted = points.join(components(found), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return rows.join(named, "node")


def _may_hold(names: DataFrame, name: Column) -> Column:
    """False only where ``name`` is not in ``names``: a filter of one hash, eight bits a name and at most ``FILTER_BITS``."""
    size = min(FILTER_BITS, 1 << max(16, (8 * names.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit("filter")), F.lit(size))
    held = names.select(bit(F.col(names.columns[0])).alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
    rows = held.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect()  # bounded, whatever the table
    bits = np.zeros(size // 64, np.int64)
    bits[[r["word"] for r in rows]] = [r["bits"] for r in rows]

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        at = column.to_numpy()
        return pd.Series((bits[at >> 6] >> (at & 63) & 1).astype(bool))

    return holds(bit(name))


def similar_groups(docs: DataFrame, words: int, blocks: int, keys: int, radius: int, total: int, least: tuple[int, int], doc_id: str = "doc_id", text: str = "text", shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, component_id) of every document: the smallest id that links of similar sets reach.

    Rows of one id must hold one text. Links are those of ``similar_links``; ``blocks`` fingerprints
    of 64 bits and ``keys`` permutations choose what is compared.
    """
    rows = stored(set_fingerprints(docs, words, blocks, keys, doc_id, text), "prints")
    points = _points_of(rows)

    def texts(met: DataFrame) -> DataFrame:
        # one document a set; those surely not asked for stay where they are
        asked = stored(met.join(points.select("node", F.col("least").alias("_name")), "node"), "asked")
        named = docs.select(F.col(doc_id).alias("_name"), whole_text(text).alias("text"))
        once = named.where(_may_hold(asked.select("_name"), F.col("_name"))).groupBy("_name").agg(F.any_value("text").alias("text"))
        return asked.join(once, "_name").drop("_name")

    return _named(rows, points, similar_links(points, texts, words, radius, total, least, shard_points)).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = stored(fingerprints(docs, words), "prints")
    hexed = F.lower(F.lpad(F.hex(F.col("print")[0]), 16, "0"))
    return group(prints, radius).select("doc_id", hexed.alias("fingerprint"), "component_id")
