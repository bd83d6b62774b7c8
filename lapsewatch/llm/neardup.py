"""Near copies by a chosen-path join: trees of minwise tokens, small nodes compared exhaustively.

A document is the set of its five-word shingles (all its words if there are fewer). Documents with
equal sets are one class from the start. In each of ``TREES`` independent trees a class follows
the path of its minwise shingles. Nodes with one class are left; nodes up to ``LEAF`` classes are
compared pair by pair; larger ones branch by further minwise shingles, and besides every class in
them is compared with a pivot. In the first trees the pivot is also the class that agrees best with
the most frequent minwise values of the node, the original of a family of copies; such a hub is
compared with all classes it shares a large first node with in any tree. Classes whose sketches say
that a pivot stands for them do not branch on, so deeper nodes grow with the number of families and
not with that of copies; the exact join below covers every class of a large first node all the same.

Sketches decide which of these pairs are worth a look; a pair is a link only if its full sets say
so: 100 * intersection >= 75 * union, on 64-bit hashes of the shingles. First every class is
confirmed with its best partner and with its pivots, linear in the number of classes; then with the
centre of each component that it has a candidate in, for pivots are seldom the original of a family and
many copies are near that one only; then whatever candidates are still in different components.

With these, classes of large first nodes are joined exactly, for branching and pivots lose links: copies
that are near their original only, and pairs among many documents with a common passage. Every
link between two components shares a shingle among the first quarter of each set, in an order that
puts shingles of one component first and frequent ones last, so only those rows are joined, and no
pair within a component is formed. A pair at similarity 0.75 is thus missed only if it shares the
first node in no tree, with a chance of 0.44 to the 32nd, or if it is met in small nodes only and its
sketches are four and a half deviations off.

A text that is null, empty or without words has the empty set and links with nothing. Repeated rows
are equal documents. Rows without a key take part, but never name a component. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, pieces_of, words, written
from lapsewatch.llm.components import components

WIDTH, SIMILAR = 5, (75, 100)
TREES, LEVELS, HASHES, LEAF = 32, (2, 4, 7, 11), 96, 24
#: Trees whose largest nodes look for the original, and minwise values that they count.
HUB_TREES, HUB_SLOTS = 4, 16
#: Least similarity of sketches to be worth a look: four and a half deviations below 0.75.
WORTH = 0.55
#: Bits of the filter that finds the texts needed; fixed, so its size does not grow.
FILTER_BITS = 1 << 24

MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
MULTIPLIERS = _random.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
#: Which minwise values a tree branches on, level by level; the first two are its own.
ORDERS = np.array([np.r_[2 * t, 2 * t + 1, _random.permutation(
    [h for h in range(HASHES) if h // 2 != t])[:max(LEVELS)]] for t in range(TREES)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(WIDTH, len(found))
    out = np.full(len(found) - width + 1, len(found) if len(found) < WIDTH else WIDTH, np.uint64)
    for i in range(width):
        out = _mixed(out + hashes[i:i + len(out)])
    return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(low), 2048):
        part = (low[None, start:start + 2048] * MULTIPLIERS[:, None]).min(axis=1)
        least = np.minimum(least, part)
    return least


def _id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, size of the set, class (equal sets, null if empty) and minwise values as bytes."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, classes, values = [], [], []
        for piece in pieces_of(batch):
            for t in piece.column(1).to_pylist():
                held = shingle_set(t)
                sizes.append(len(held))
                classes.append(_id(held) if len(held) else None)
                values.append(minwise(held).tobytes() if len(held) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
             pa.array(values, pa.binary())], ["key", "size", "class", "minwise"])

    return by_batch(df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")),
                    work, "key bigint, size bigint, class bigint, minwise binary")


def _values(column: pa.Array) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint32).reshape(len(held), HASHES)


def _node(values: np.ndarray, tree: np.ndarray, level: int) -> np.ndarray:
    """The node of each row's path at a level of its tree, as a hash."""
    node = _mixed(tree.astype(np.uint64) + np.uint64(level * 1000 + 1))
    picked = np.take_along_axis(values, ORDERS[tree][:, :level], axis=1).astype(np.uint64)
    for i in range(level):
        node = _mixed(node + picked[:, i] * np.uint64(0xFF51AFD7ED558CCD))
    return node.astype(np.int64)


def _first_nodes(classes: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, tree = _values(batch.column(1)), np.arange(TREES)
        at = np.repeat(np.arange(len(values)), TREES)
        trees = np.tile(tree, len(values))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array(trees.astype(np.int32)),
             pa.array(np.concatenate([_node(values[i:i + 2000].repeat(TREES, 0),
                                            np.tile(tree, len(values[i:i + 2000])), LEVELS[0])
                                      for i in range(0, len(values), 2000)]))],
            ["class", "tree", "node"])
    return by_batch(classes.select("class", "minwise"), work, "class bigint, tree int, node bigint")


def _next_nodes(members: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = _node(_values(batch.column(2)), batch.column(1).to_numpy(), level)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node)],
                                          ["class", "tree", "node"])
    rows = members.join(classes.select("class", "minwise"), "class").select("class", "tree", "minwise")
    return by_batch(rows, work, "class bigint, tree int, node bigint")


def _hubs(big: DataFrame, classes: DataFrame) -> DataFrame:
    """node, hub: the class that has most of the node's most frequent minwise values."""
    members = written(big.where(F.col("tree") < HUB_TREES).join(
        classes.select("class", "minwise"), "class").select("node", "class", "minwise"), "members")

    def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = _values(batch.column(1))[:, -HUB_SLOTS:]
        at = pa.array(np.repeat(np.arange(len(values)), HUB_SLOTS))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at),
             pa.array(np.tile(np.arange(HUB_SLOTS, dtype=np.int32), len(values))),
             pa.array(values.ravel().astype(np.int64))], ["node", "slot", "value"])

    counted = by_batch(members.select("node", "minwise"), slots, "node bigint, slot int, value bigint")
    usual = (counted.groupBy("node", "slot", "value").count()
             .groupBy("node", "slot").agg(F.max(F.struct("count", "value"))["value"].alias("value"))
             .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("slot", "value")))["value"].alias("usual")))
    usual = written(usual, "usual")

    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = _values(batch.column(2))[:, -HUB_SLOTS:].astype(np.int64)
        same = (values == np.array(batch.column(3).to_pylist(), np.int64)).sum(axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)],
                                          ["node", "class", "same"])

    near = by_batch(members.join(usual, "node").select("node", "class", "minwise", "usual"), agree,
                    "node bigint, class bigint, same bigint")
    return near.groupBy("node").agg(F.max(F.struct("same", "class"))["class"].alias("hub"))


def _hub_spokes(big: DataFrame, hubs: DataFrame) -> DataFrame:
    """class, pivot: every class of a large node with that of the hubs there that most nodes named."""
    big = big.select("class", "node")
    named = hubs.groupBy(F.col("hub").alias("class")).agg(F.count(F.lit(1)).alias("votes"))
    first = written(big.join(named, "class").groupBy("node").agg(
        F.max(F.struct("votes", "class"))["class"].alias("pivot")), "named")
    return big.join(first, "node").select("class", "pivot")


def _sketch(values: np.ndarray) -> np.ndarray:
    """A byte of each minwise value."""
    return ((values * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity, without the chance that bytes agree."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


PAIR = "a bigint, b bigint, alike double"


def _pairs(a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    keep = (alike >= WORTH) & (a != b)
    a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alike[keep])],
                                      ["a", "b", "alike"])


def _leaf_pairs(leaves: DataFrame) -> DataFrame:
    """All pairs of a small node; nodes are runs of sorted rows, at most ``LEAF`` long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                node = part.column(0).to_numpy()
                ids = part.column(1).to_numpy()
                held = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), HASHES)
                seen = 0
                if rest is not None:
                    seen = len(rest[0])
                    node, ids, held = (np.concatenate(x) for x in zip(rest, (node, ids, held)))
                rest = tuple(x[-LEAF:] for x in (node, ids, held))
                for step in range(1, LEAF):
                    # Pairs within what was carried over have been compared already.
                    at = np.flatnonzero(node[step:] == node[:-step]) if step < len(node) else np.zeros(0, int)
                    at = at[at + step >= seen]
                    if len(at):
                        yield _pairs(ids[at], ids[at + step], _alike(held[at], held[at + step]))
    return leaves.mapInArrow(run, PAIR)


def _looked_at(spokes: DataFrame, small: DataFrame) -> DataFrame:
    """class, pivot, alike: the spokes whose sketches are worth a look."""
    both = (spokes.where("class <> pivot").join(small, "class")
            .join(small.select(F.col("class").alias("pivot"), F.col("sketch").alias("other")), "pivot")
            .select("class", "pivot", "sketch", "other"))

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES)
                    for i in (2, 3))
        alike = _alike(one, two)
        keep = pa.array(np.flatnonzero(alike >= WORTH))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(alike).take(keep)],
            ["class", "pivot", "alike"])

    return written(by_batch(both, look, "class bigint, pivot bigint, alike double"), "spokes")


def _stood_for(near: DataFrame, spokes: DataFrame) -> DataFrame:
    """Classes that a pivot stands for. A pivot is stood for by pivots of lower number only, so that one stays."""
    share = SIMILAR[0] / SIMILAR[1]
    pivots = spokes.select(F.col("pivot").alias("class"), F.lit(True).alias("leads")).distinct()
    return written(near.where(F.col("alike") >= share).join(pivots, "class", "left").where(
        "leads IS NULL OR pivot < class").select("class").distinct(), "stood-for")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of classes that meet in a small node or at a pivot, with their estimated similarity.

    star tells pairs with a pivot. Beside them the classes of large first nodes, if there are any.
    """
    def sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = _sketch(_values(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h.tobytes() for h in held], pa.binary())], ["class", "sketch"])

    small = written(by_batch(classes.select("class", "minwise"), sketches, "class bigint, sketch binary"), "sketches")
    rows = _first_nodes(classes)
    leaves, stars, crowded = [], [], None
    for turn, level in enumerate(LEVELS):
        order = F.xxhash64("class", F.lit(21))
        # Written, so that joins with it may split a node that very many classes share.
        counts = written(rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "class"))["class"].alias("pivot")).where("n > 1"), "counts")
        nodes = written(rows.join(counts, "node"), "nodes")
        leaves.append(nodes.where(F.col("n") <= LEAF).select("node", "class"))
        big = nodes.where(F.col("n") > LEAF)
        if big.isEmpty():
            break
        spokes = big.select("class", "pivot")
        if turn == 0:
            crowded = written(big.select("class").distinct(), "crowded")
            hubs = written(_hubs(big, classes), "hubs")
            spokes = spokes.union(big.join(hubs, "node").select("class", F.col("hub").alias("pivot")))
            spokes = spokes.union(_hub_spokes(big, hubs))
        spokes = written(spokes.distinct(), "pivots")
        near = _looked_at(spokes, small)
        stars.append(near)
        if turn + 1 < len(LEVELS):
            open_ = big.select("class", "tree").join(_stood_for(near, spokes), "class", "left_anti")
            rows = written(_next_nodes(open_, classes, LEVELS[turn + 1]), "deeper")

    together = leaves[0]
    for more in leaves[1:]:
        together = together.union(more)
    sorted_ = (together.join(small, "class").select("node", "class", "sketch")
               .repartition("node").sortWithinPartitions("node"))
    found = _leaf_pairs(sorted_).withColumn("star", F.lit(False))
    for near in stars:
        found = found.union(near.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b"),
                                        "alike", F.lit(True).alias("star")))
    pairs = found.groupBy("a", "b").agg(F.max("alike").alias("alike"), F.max("star").alias("star"))
    return written(pairs, "pairs"), crowded


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each key's hash; at most a word per 64 bits reaches the driver."""
    bit = keys.select(F.pmod(F.xxhash64("key", F.lit(31)), F.lit(FILTER_BITS)).alias("at"))
    word = bit.selectExpr("CAST(at div 64 AS INT) AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS bit")
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in word.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r.word] = r.bits
    return out


def full_sets(df: DataFrame, key: str, text: str, classes: DataFrame, ends: DataFrame) -> DataFrame:
    """class and its whole set, for the classes in ends; only the texts needed are read again."""
    needed = written(ends.join(classes.select("class", F.col("least").alias("key")), "class"), "needed")
    bits = _filter(needed)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit = batch.column(2).to_numpy()
        hit = (bits[bit // 64] >> (bit % 64)) & 1 == 1
        return batch.filter(pa.array(hit)).select(["key", "text"])

    docs = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null")
    docs = docs.withColumn("bit", F.pmod(F.xxhash64("key", F.lit(31)), F.lit(FILTER_BITS)))
    docs = by_batch(docs, keep, "key bigint, text string")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = [], []
        for piece in pieces_of(batch):
            for wanted, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                held = shingle_set(t)
                # A key may come with several texts; its class says which one is meant.
                if len(held) and _id(held) == wanted:
                    ids.append(wanted)
                    sets.append(held.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())],
                                          ["class", "held"])

    # Merged, so that a shuffle parts the two steps in Python: in one stage each would hold a worker of its own.
    return written(by_batch(docs.join(needed.hint("merge"), "key").select("class", "text"), work,
                            "class bigint, held binary"), "sets")


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs whose sets are similar enough."""
    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for piece in pieces_of(batch, 64):
            for one, two in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = (pairs.select("a", "b").join(sets.select(F.col("class").alias("a"), F.col("held").alias("one")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("held").alias("two")), "b")
            .select("a", "b", "one", "two"))
    with batches_of(rows.sparkSession, 256):
        return written(by_batch(rows, confirm, "a bigint, b bigint").distinct(), "links")


def across(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of classes in different components, with every link between such among them.

    Shingles are ordered: those of one component, then by how many classes have them. The first common
    shingle of two similar sets is early in both: in the larger one before all that the least
    intersection for its size needs, in the smaller one likewise for equal sizes. Shingles of one
    component count for the places only. In each list of classes all but the most frequent component
    are compared with all, so a family is never compared with itself.
    """
    low, whole = SIMILAR

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.frombuffer(h, np.uint64).astype(np.int64) for h in batch.column(2).to_pylist()]
        sizes = np.array([len(h) for h in held], np.int64)
        at = pa.array(np.repeat(np.arange(len(held)), sizes))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(sizes, sizes)),
             pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))],
            ["class", "component", "size", "shingle"])

    named = sets.join(known, F.col("class") == F.col("node"), "left").select(
        "class", F.coalesce("component", "class").alias("component"), "held")
    tokens = by_batch(named, shingles, "class bigint, component bigint, size bigint, shingle bigint", 64)
    mixed = tokens.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
    ).where("low <> high").select("shingle", "n")
    ordered = tokens.join(mixed, "shingle").groupBy("class", "component", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    # Places count from 0; the shingles of one component come before those that are held here.
    early = ordered.withColumn("before", F.expr("size - size(held)")).withColumn(
        "probes", F.expr(f"size - ceil({low} * size / {whole}) + 1 - before")).where("probes > 0")
    prefixes = written(early.select(
        "class", "component", "size", "before", F.posexplode(F.expr("slice(held, 1, CAST(probes AS INT))")))
        .select("class", "component", "size", F.col("col.shingle").alias("shingle"),
                (F.col("before") + F.col("pos")).alias("at"))
        .withColumn("indexed", F.expr(f"at <= size - ceil(2 * {low} * size / {low + whole})")), "prefixes")
    most = (prefixes.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle")
            .agg(F.max(F.struct("n", "component"))["component"].alias("most"), F.count(F.lit(1)).alias("kinds"))
            .where("kinds > 1").select("shingle", "most"))
    few = prefixes.join(most, "shingle").where("component <> most").drop("most")
    met = few.alias("x").join(prefixes.alias("y"), F.expr(f"""
        x.shingle = y.shingle AND x.component <> y.component
        AND (x.size >= y.size AND y.indexed OR y.size >= x.size AND x.indexed)
        AND {whole} * least(x.size, y.size) >= {low} * greatest(x.size, y.size)
        AND {low + whole} * least(x.size - x.at, y.size - y.at) >= {low} * (x.size + y.size)"""))
    return written(met.selectExpr("least(x.class, y.class) AS a", "greatest(x.class, y.class) AS b").distinct(),
                   "across")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those pairs whose classes are in different components, with these as of_a and of_b."""
    one, two = (known.select(F.col("node").alias(n), F.col("component").alias(f"in_{n}")) for n in "ab")
    return (pairs.join(one, "a", "left").join(two, "b", "left")
            .select("a", "b", F.coalesce("in_a", "a").alias("of_a"), F.coalesce("in_b", "b").alias("of_b"))
            .where("of_a <> of_b"))


def centres(sets: DataFrame, members: DataFrame) -> DataFrame:
    """component, centre: the member that differs least from what more than half of its component holds.

    One pass over the shingles counts them; what most members hold is no longer than twice their mean set.
    """
    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.frombuffer(h, np.uint64).astype(np.int64) for h in batch.column(1).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))],
            ["component", "shingle"])

    def differ(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [len(np.setxor1d(np.frombuffer(h, np.uint64), np.array(u, np.int64).astype(np.uint64), True))
                  for h, u in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                          ["component", "class", "differ"])

    held = sets.join(members, "class").select("component", "class", "held")
    counted = by_batch(held.select("component", "held"), shingles, "component bigint, shingle bigint", 64).groupBy(
        "component", "shingle").agg(F.count(F.lit(1)).alias("holders"))
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "member-counts")
    usual = written(counted.join(sizes, "component").where("2 * holders > n").groupBy("component").agg(
        F.collect_list("shingle").alias("usual")), "usual-shingles")
    near = by_batch(held.join(usual, "component"), differ, "component bigint, class bigint, differ bigint", 64)
    return near.groupBy("component").agg(F.min(F.struct("differ", "class"))["class"].alias("centre"))


def to_centres(sets: DataFrame, known: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs of a class and the centre of a component that it has a candidate in.

    The first pivots of a family are seldom its original, and many copies are near that one only. Left in
    components of their own, each of them would meet the whole family in ``across``.
    """
    met = written(apart.selectExpr("a AS class", "of_b AS component").union(
        apart.selectExpr("b AS class", "of_a AS component")).distinct(), "met")
    members = known.join(met.select("component").distinct(), "component").select(F.col("node").alias("class"), "component")
    many = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("component")
    found = written(centres(sets, written(members.join(many, "component", "left_semi"), "in-components")), "centres")
    return met.join(found, "component").select(
        F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links: only components that these connect are gone through again."""
    edges = written(_apart(links, known).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "bridges")
    if edges.isEmpty():
        return known
    moved = written(components(edges), "moved")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    before = known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(before.union(moved.join(known, "node", "left_anti").select("node", "component")), "components")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most: rows that carry texts or whole sets are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row: key, n_shingles, component_id (least key reachable) and kept."""
    with batches_of(df.sparkSession, 1000):
        return _near_duplicates(df, key, text)


def _near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = written(signatures(df, key, text), "signatures")
    classes = written(rows.where("class is not null").groupBy("class").agg(
        F.min("key").alias("least"), F.min("minwise").alias("minwise")).where("least is not null"), "classes")
    pairs, crowded = candidates(classes)
    ways = pairs.select("a", "b", "alike").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    ends = ways.select(F.col("a").alias("class"))
    sets = full_sets(df, key, text, classes, (ends if crowded is None else ends.union(crowded)).distinct())
    best = ways.groupBy("a").agg(F.max(F.struct("alike", "b"))["b"].alias("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = written(best.union(pairs.where("star").select("a", "b")).distinct(), "first")
    known = written(components(confirmed(sets, first)), "components")
    seen = first
    if crowded is not None:
        spokes = written(to_centres(sets, known, _apart(pairs, known)).join(first, ["a", "b"], "left_anti"), "to-centres")
        known, seen = joined(known, confirmed(sets, spokes)), first.union(spokes)
    apart = _apart(pairs, known).select("a", "b")
    if crowded is not None:
        apart = apart.union(across(sets.join(crowded, "class", "left_semi"), known)).distinct()
    # What was confirmed or refused above is not looked at again.
    final = joined(known, confirmed(sets, written(apart.join(seen, ["a", "b"], "left_anti"), "second")))
    named = classes.select("class", "least").join(final, F.col("class") == F.col("node"), "left").select(
        "class", "least", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = written(named.join(least, "component").select("class", "component_id"), "answer")
    out = rows.select("key", "size", "class").join(answer, "class", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
