"""Posting lists, links and components: what the two near-duplicate operators share.

Candidates come as rows (key, node): nodes that share a key may be linked. Lists are
formed by one shuffle on the key. Links are then found in rounds: first each node is
compared with one other of its lists, and the graph of the links found is reduced to
components; then only nodes of a list that still lie in different components are
compared, by so many of its nodes at a time. A list whose nodes are all connected is
done, so a group of thousands of near copies costs a few comparisons for each copy,
and yet no two nodes of one list are left neither compared nor connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import drop_saved, map_stream, saved

#: Parts of the keys' range for each shuffle partition; rows of a part that are held before full pieces are sent on.
PARTS, HELD = 16, 1 << 21
#: Nodes of a list packed in one row; of a list compared in full at once; most rounds
#: with one pair for each node, which go on while half of the pairs are links;
#: nodes of a list compared with the rest in each later round; names of lists that a
#: task remembers; ids that may be broadcast.
PACK, SHORT, QUICK_ROUNDS, PIVOTS, REMEMBERED, BROADCAST_IDS = 512, 4, 6, 256, 500_000, 1_000_000
#: Parity bits of a set.
BITS = 1024

Verify = Callable[[DataFrame], DataFrame]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


#: Columns of a block: the part of the keys' range that it is of, and as many keys as nodes.
BLOCKS = "part int, keys binary, nodes binary"


def n_parts(spark: SparkSession) -> int:
    """Parts that keys are dealt into: so many for each shuffle partition that partitions come out even."""
    return PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(keys: np.ndarray, nodes: np.ndarray, parts: int) -> dict[str, list]:
    """Blocks of the rows (key, node), one for each part that has any.

    Of a key 32 bits travel beside its part. Keys that come to be equal by that only
    make a list longer; its nodes are compared like all others.
    """
    with np.errstate(over="ignore"):
        keys = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    with np.errstate(over="ignore"):
        short = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, short, nodes = part[order], short[order].tobytes(), nodes[order].tobytes()
    cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)] if len(part) else []
    sides = list(zip(cuts, cuts[1:]))
    return {"part": part[cuts[:-1]].astype(np.int32), "keys": [short[4 * a : 4 * b] for a, b in sides], "nodes": [nodes[8 * a : 8 * b] for a, b in sides]}


class _Lists:
    """Lists of two nodes or more from the rows of one part after the other.

    A list of at most ``pack`` nodes is named by a hash of them, so that equal lists meet
    and one of them stays; a longer one is named by its key and comes in pieces, which
    are sent on as soon as they are full, so that a key with very many nodes takes no
    more memory than others. The first node of a list is in all of its pieces, so that
    those that are similar to it are connected from the start.
    """

    def __init__(self, pack: int, least: int) -> None:
        self.pack, self.least = pack, least
        self.rows: list[tuple[int, int, np.ndarray]] = []
        self.seen: set[int] = set()
        self.part = 0
        self.start()

    def start(self) -> None:
        self.keys, self.nodes, self.held, self.most = [], [], 0, self.least
        self.sent: dict[int, tuple[int, int]] = {}

    def add(self, keys: bytes, nodes: bytes) -> None:
        self.keys.append(np.frombuffer(keys, np.uint32))
        self.nodes.append(np.frombuffer(nodes, np.int64))
        self.held += len(self.keys[-1])
        if self.held > self.most:
            keys, nodes, cuts = self.sorted()
            keep = np.ones(len(keys), bool)
            for a, b in zip(cuts, cuts[1:]):
                size = self.pack - 1  # room for the first node
                if b - a > size:
                    nodes[a:b] = self.mixed(int(keys[a]), nodes[a:b])
                for at in range(a, b - size, size):
                    self.piece(int(keys[a]), nodes[at : at + size])
                    keep[at : at + size] = False
            self.keys, self.nodes, self.held = [keys[keep]], [nodes[keep]], int(keep.sum())
            self.most = max(self.least, 2 * self.held)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        keys, nodes = np.concatenate(self.keys), np.concatenate(self.nodes)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
        keys, nodes = keys[new], nodes[new]
        return keys, nodes, [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)]

    def mixed(self, key: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of a long list in an order of its key's own.

        Similar nodes share many keys, and so meet others in the pieces of each: were
        all lists cut in the order of the nodes, the same would meet in all of them.
        """
        with np.errstate(over="ignore"):
            code = (nodes.view(np.uint64) ^ np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        return nodes[np.argsort(code ^ (code >> np.uint64(32)), kind="stable")]

    def piece(self, key: int, nodes: np.ndarray) -> None:
        before, anchor = self.sent.get(key, (0, nodes[0]))
        self.rows.append((_signed((self.part << 32) + key), before, np.r_[anchor, nodes[nodes != anchor]] if before else nodes))
        self.sent[key] = before + len(nodes), anchor

    def close(self) -> None:
        """Ends a part."""
        if self.held:
            keys, nodes, cuts = self.sorted()
            sizes = np.diff(cuts)
            for i in np.flatnonzero((sizes > 1) | (np.isin(keys[cuts[:-1]], list(self.sent)) if self.sent else False)).tolist():
                a, b = cuts[i], cuts[i + 1]
                key = int(keys[a])
                if key in self.sent or b - a > self.pack:
                    nodes[a:b] = self.mixed(key, nodes[a:b])
                    for at in range(a, b, self.pack - 1):
                        self.piece(key, nodes[at : min(b, at + self.pack - 1)])
                    continue
                name = _signed(xxhash.xxh3_64_intdigest(nodes[a:b].tobytes()))
                if name not in self.seen:
                    if len(self.seen) > REMEMBERED:
                        self.seen.clear()
                    self.seen.add(name)
                    self.rows.append((name, 0, nodes[a:b]))
        self.start()

    def out(self) -> dict[str, list]:
        ids, ranks, nodes = zip(*self.rows)
        self.rows.clear()
        return {"list_id": ids, "first_rank": ranks, "nodes": nodes}


def block_lists(blocks: DataFrame, pack: int | None = None) -> DataFrame:
    """(list_id, first_rank, nodes) of all lists of two nodes or more, packed, from blocks of rows (key, node); saved.

    Of lists with the same nodes one is kept. Two different lists share a name with odds of 2^-64.
    """
    pack, least = pack or PACK, HELD

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        lists, part = _Lists(pack, least), None
        for batch in batches:
            for now, keys, nodes in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "nodes"))):
                if now != part:
                    lists.close()
                    part = lists.part = now
                lists.add(keys, nodes)
            if len(lists.rows) > 4096:
                yield lists.out()
        lists.close()
        if lists.rows:
            yield lists.out()

    dealt_out = blocks.repartition("part").sortWithinPartitions("part")
    packed = map_stream(dealt_out, work, "list_id long, first_rank long, nodes array<long>")
    return saved(packed.dropDuplicates(["list_id", "first_rank"]))


def _is_flat(edges: DataFrame) -> bool:
    """Whether each node of the edges (u, v), u > v, has one smaller neighbour or is a root."""
    sides = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    held = edges.select(F.inline(sides)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the edges (a, b); saved.

    Alternates two star steps until all trees are flat: each node hands its larger
    neighbours to its smallest, then its smaller ones. The number of steps grows with
    the logarithm of the longest chain, not with the size of a component.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _is_flat(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(moved.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        drop_saved(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots))


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers: bit i is set where an odd number of the tokens have i in their low bits.

    Sets whose bits differ in d places differ by d tokens or more.
    """
    counts = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _admits(bound: int, n: str, bits: str, other_n: str, other_bits: str) -> Column:
    """True unless sizes or parity bits prove that two sets' similarity is below ``bound`` hundredths."""
    differ = sum((F.bit_count(F.get(bits, i).bitwiseXOR(F.get(other_bits, i))) for i in range(BITS // 64)), F.lit(0))
    total = F.col(n) + F.col(other_n)
    sizes = 100 * F.least(n, other_n) >= bound * F.greatest(n, other_n)
    return sizes & (differ * (100 + bound) <= total * (100 - bound))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _one_for_each(left: DataFrame, turn: int, bound: int) -> DataFrame:
    """One pair for each node: itself and the head of one of its lists.

    In the first turn a list's head is its node that is in most lists: an original has
    fewer tokens of its own than its altered copies have, and so more in common with
    them. Later it is the node with the least hash of the turn. Lists with many nodes
    in common have few heads between them.
    """
    hashed = left.withColumn("h", -F.col("degree") if turn == 0 else F.xxhash64("node", F.lit(turn)))
    heads = hashed.groupBy("list_id").agg(F.min(F.struct("h", "node", "comp", "n", "bits")).alias("head"))
    heads = heads.select("list_id", *[F.col(f"head.{c}").alias(f"head_{c}") for c in ("h", "node", "comp", "n", "bits")])
    on = (hashed["list_id"] == heads["list_id"]) & (F.col("comp") != F.col("head_comp"))
    met = hashed.join(heads, on & _admits(bound, "n", "bits", "head_n", "head_bits"))
    best = met.groupBy("node").agg(F.min(F.struct("head_h", "head_node")).alias("head"))
    return _pairs(best.select("node", F.col("head.head_node").alias("other")))


def _all_of_some(left: DataFrame, done: DataFrame | None, bound: int) -> tuple[DataFrame, DataFrame]:
    """All open pairs of up to PIVOTS nodes of each list, and these nodes as (list_id, node); saved.

    Nodes of the component with most nodes in a list needn't be compared from their
    side: the others meet them all.
    """
    sizes = left.groupBy("list_id", "comp").agg(F.count("*").alias("m"))
    major = sizes.groupBy("list_id").agg(F.max(F.struct("m", "comp")).alias("m")).select("list_id", F.col("m.comp").alias("major"))
    minor = left.join(major, "list_id").where("comp <> major")
    if done is not None:
        minor = minor.join(done, ["list_id", "node"], "left_anti")
    turn = F.row_number().over(W.partitionBy("list_id").orderBy("node"))
    some = minor.withColumn("turn", turn).where(F.col("turn") <= PIVOTS)
    some = saved(some.select("list_id", *[F.col(c).alias(f"other_{c}") for c in ("node", "comp", "n", "bits")]))
    on = (left["list_id"] == some["list_id"]) & (F.col("comp") != F.col("other_comp"))
    met = left.join(some, on & _admits(bound, "n", "bits", "other_n", "other_bits"))
    return _pairs(met.withColumnRenamed("other_node", "other")), some.select("list_id", F.col("other_node").alias("node"))


def _pairs_of_short(packed: DataFrame, traits: DataFrame, bound: int) -> DataFrame:
    """All pairs of the lists of at most SHORT nodes: linear in the number of lists."""
    each = F.flatten(
        F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    pairs = packed.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct()
    of = lambda c: traits.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    first, second = pairs.join(of("a"), "a"), of("b").withColumnRenamed("b", "node_b")
    on = (F.col("b") == F.col("node_b")) & _admits(bound, "n_a", "bits_a", "n_b", "bits_b")
    return first.join(second, on).select("a", "b")


def linked_components(packed: DataFrame, traits: DataFrame, bound: int, verify: Verify) -> DataFrame:
    """(node, comp) of all nodes with a link, from posting lists and a check of pairs; saved.

    ``traits``: node, n, bits: the size and the parity bits of each node's set.
    ``verify`` takes distinct pairs (a, b), a < b, and returns those that are linked.
    Short lists are compared in full at once. Of the others, the first rounds compare
    each node with one other; what these leave unconnected is compared in full.
    """
    traits = saved(traits.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))
    is_short = (F.col("first_rank") == 0) & (F.size("nodes") <= min(SHORT, PACK - 2))
    lists = packed.where(~is_short).select("list_id", F.explode("nodes").alias("node"))
    degrees = lists.groupBy("node").agg(F.count("*").alias("degree"))
    lists = saved(lists.join(degrees.join(traits, "node"), "node"))
    # Before the first links each node is its own component.
    heads = _one_for_each(lists.withColumn("comp", F.col("node")), 0, bound)
    tried = saved(_pairs_of_short(packed.where(is_short), traits, bound).unionByName(heads).distinct())
    return connect_lists(lists, components(verify(tried)), bound, verify, tried)


def connect_lists(lists: DataFrame, comps: DataFrame, bound: int, verify: Verify, tried: DataFrame | None = None, quick_rounds: int | None = None) -> DataFrame:
    """``comps`` with all links within the lists (list_id, node, n, bits) that don't lie within one of them; saved.

    ``tried``: pairs (a, b) that were compared. ``quick_rounds``: rounds, less one, with
    one pair for each node, before those that compare some nodes with all. Rounds go on until no two nodes of a
    list are left neither compared nor connected.
    """
    done, turn, quick = None, 1, True
    while True:
        state = lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = state.groupBy("list_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list_id")
        left = saved(state.join(split, "list_id"))
        if left.isEmpty():
            return comps
        lists = left.drop("comp")  # a list that is connected stays so
        quick = quick and turn < (QUICK_ROUNDS if quick_rounds is None else quick_rounds)
        if quick:
            pairs = _one_for_each(left, turn, bound)
        else:
            pairs, some = _all_of_some(left, done, bound)
            if some.isEmpty():
                return comps
            done = some if done is None else done.unionByName(some)
        new = saved(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
        tried, turn = new if tried is None else tried.unionByName(new), turn + 1
        n_new = new.count()
        found = verify(new) if n_new else new
        n_found = found.count()
        quick = quick and 2 * n_found > n_new
        if n_found:
            stars = comps.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))
            comps = components(stars.unionByName(found))


def only_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` is among the ids, which are broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")
