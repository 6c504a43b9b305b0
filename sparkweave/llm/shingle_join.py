"""Operator 6: n-gram Jaccard join by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct five-word shingles. All
tokens are put in one order: rare ones before frequent ones, each by value. Two sets
whose Jaccard similarity reaches the bound share a token within their prefixes, so
rare tokens of the prefix are indexed singly. A set whose prefix reaches into the
frequent tokens has it extended, and pairs of its frequent tokens are indexed: with
the frequent tokens dealt into g classes and the prefix g tokens longer, two such sets
that share no rare token share g + 1 frequent ones, and so two of one class. Pairs of
documents that meet are verified on their whole texts.

Copies with the same set are one class and joined once. Which tokens count as frequent
changes the cost only, never the result. Two different shingles share a hash with odds
of 2^-64, which bears on the verdict of a pair only if both are in it.

Cases: a null or empty text, or one without words, has no shingles and is a component
of its own; a text of fewer than five words has one shingle, the whole sequence; a
null doc_id has a null component and links nothing; rows that share a doc_id have the
same component, and the links of all of them count for it, while ``one_of_each`` takes
such rows for documents of their own, so that no text goes without one like it that
stays; of rows equal in doc_id and text it keeps one; an empty table gives an empty
table; other columns are ignored or carried.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window as W

from .frames import Scratch, drop_saved, map_batches, saved, texts_of
from .linkage import BLOCKS, BROADCAST_IDS, block_lists, components, dealt, linked_components, n_parts, only_ids, parity_bits

#: Words of a shingle; the bound in hundredths.
WORDS, BOUND = 5, 80
#: A token in more sets than this is frequent; so many of them are told apart, the most
#: frequent first. Further tokens kept with each set beside its prefix, of each 100.
FREQUENT, FREQUENT_KNOWN, SPARE = 32, 1 << 20, 15
#: Sets below SINGLE tokens index frequent tokens singly; above, one class for each PER_CLASS.
SINGLE, PER_CLASS = 16, 16
MEMO_WORDS = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Shingler:
    """The distinct shingle hashes of a text, sorted."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = list(map(memo.get, words))
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    if (h := memo.get(w)) is None:
                        h = xxhash.xxh3_64_intdigest(w)
                        if len(w) <= 64:
                            memo[w] = h
                    found[i] = h
        return np.array(found, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        # Bytes know just the letters A-Z and the white space that the words are made by.
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h, size = self.hashes(words), min(len(words), WORDS)
        n = len(h) - size + 1
        total = np.full(n, np.uint64(size))
        with np.errstate(over="ignore"):
            for k in range(size):
                total *= np.uint64(0x9E3779B97F4A7C15)
                total += h[k : k + n]
        total = np.sort(_mix(total))
        return total[np.r_[True, total[1:] != total[:-1]]]


def least_shared(n: int) -> int:
    """Tokens that a set of n shares at least with any set that is similar to it."""
    return -(-BOUND * n // 100)


def prefix_length(n: int) -> int:
    return n - least_shared(n) + 1


def n_classes(n: int) -> int:
    """Classes of frequent tokens for sets of n; 0: index them singly."""
    return 0 if n < SINGLE else 1 << ((n // PER_CLASS).bit_length() - 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= BOUND * (len(a) + len(b) - shared)


def may_be_similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """False where two sets, of each of which the smallest tokens are given, can't be similar.

    Up to the smaller of their last tokens both are known in full; if they already
    differ there by more tokens than similar sets may differ by, they aren't similar.
    """
    ends = [x[-1] for x, n in ((a, n_a), (b, n_b)) if len(x) < n]
    if ends:
        a, b = a[: np.searchsorted(a, min(ends), "right")], b[: np.searchsorted(b, min(ends), "right")]
    at = np.searchsorted(a, b)
    inside = at < len(a)
    shared = int(np.count_nonzero(a[at[inside]] == b[inside]))
    return (len(a) + len(b) - 2 * shared) * (100 + BOUND) <= (n_a + n_b) * (100 - BOUND)


def index_keys(tokens: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray | None:
    """Keys under which a set of n tokens is indexed; None if more of its tokens are needed.

    ``tokens``: its smallest tokens or all, sorted. ``frequent``: the frequent ones, sorted.
    """
    at = np.searchsorted(frequent, tokens)
    often = np.zeros(len(tokens), bool)
    inside = at < len(frequent)
    often[inside] = frequent[at[inside]] == tokens[inside]
    rare, length = tokens[~often], prefix_length(n)
    if len(rare) >= length:
        return rare[:length]
    if len(tokens) < n:
        return None
    keys, common = [rare], tokens[often]
    for g in sorted({n_classes(m) for m in range(least_shared(n), n + 1)}):
        first = common[: length + g - len(rare)]
        if g == 0:
            keys.append(first)
            continue
        group = (first >> np.uint64(7)) & np.uint64(g - 1)
        for c in range(g):
            own = first[group == c]
            i, j = np.triu_indices(len(own), 1)
            with np.errstate(over="ignore"):
                keys.append(_mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + _mix(own[j] + np.uint64(g))))
    return np.unique(np.concatenate(keys))


def token_sets(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, set_key (equal for equal sets, null if empty), tokens: the smallest ones as bytes, bits."""

    def make():
        shingler = Shingler()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            sets = [shingler(t) for t in texts_of(batch)]
            take = [n_kept(len(s)) for s in sets]
            return {
                "doc_id": batch.column("doc_id"),
                "row": batch.column("row"),
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "tokens": [s[:k].tobytes() for s, k in zip(sets, take)],
                "bits": list(map(parity_bits, sets)),
            }

        return work

    kinds = "doc_id long, row long, n_shingles int, set_key binary, tokens binary, bits array<long>"
    return map_batches(docs.select("doc_id", "row", "text"), make, kinds)


def _frequent(tokens: DataFrame) -> np.ndarray:
    """The most frequent of the tokens (token, n) that more than FREQUENT sets hold, sorted; at most FREQUENT_KNOWN."""
    counts = tokens.groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_KNOWN).select("token")
    return np.sort(top.toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def frequent_kept(classes: DataFrame) -> np.ndarray:
    """Frequent ones of the tokens that are kept with the sets."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            return _counted([np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()])

        return work

    return _frequent(map_batches(classes.select("tokens"), make, "token long, n long"))


def _counted(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    return {"token": tokens.view(np.int64), "n": n}


def n_kept(n: int) -> int:
    """Tokens that are kept with a set of n."""
    return prefix_length(n) * (100 + SPARE) // 100 + 2


def frequent_whole(texts: DataFrame) -> np.ndarray:
    """Frequent ones of the tokens of these documents that aren't kept with their sets."""

    def make():
        shingler = Shingler()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            return _counted([s[n_kept(len(s)) :] for s in map(shingler, texts_of(batch))])

        return work

    return _frequent(map_batches(texts.select("text"), make, "token long, n long"))


def _index(sets: DataFrame, frequent, whole: bool) -> DataFrame:
    """Blocks of (key, node) of the sets, from their texts if ``whole``, else from the tokens kept with them."""
    parts = n_parts(sets.sparkSession)

    def make():
        known = np.frombuffer(frequent.value, np.uint64)
        shingler = Shingler()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            if whole:
                sets = [shingler(t) for t in texts_of(batch)]
                sizes = list(map(len, sets))
            else:
                sets = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
                sizes = batch.column("n_shingles").to_pylist()
            keys = [index_keys(tokens, n, known) for tokens, n in zip(sets, sizes)]
            keys = [np.empty(0, np.uint64) if k is None else k for k in keys]
            nodes = np.repeat(batch.column("node").to_numpy(), list(map(len, keys)))
            return dealt(np.concatenate(keys).view(np.int64), nodes, parts)

        return work

    columns = ("node", "text") if whole else ("node", "n_shingles", "tokens")
    return map_batches(sets.select(*columns), make, BLOCKS)


def _wanting(classes: DataFrame, frequent) -> DataFrame:
    """The nodes whose kept tokens don't reach far enough: too many of them are frequent."""

    def make():
        known = np.frombuffer(frequent.value, np.uint64)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            rows = zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), batch.column("n_shingles").to_pylist())
            return {"node": [node for node, t, n in rows if index_keys(np.frombuffer(t, np.uint64), n, known) is None]}

        return work

    return map_batches(classes.select("node", "n_shingles", "tokens"), make, "node long")


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of a document of each of the nodes' classes, more than once if its row repeats."""
    one = saved(only_ids(classes.select("node", "doc_id", "row"), nodes, "node"))
    few = 4 * one.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(one) if few else one, ["doc_id", "row"]).select("node", "text")


def _verifier(docs: DataFrame, classes: DataFrame):
    """A check of pairs: by the tokens kept with the sets, then on the whole texts."""

    def can():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            columns = (batch.column(c).to_pylist() for c in ("tokens_a", "n_a", "tokens_b", "n_b"))
            tokens = lambda t: np.frombuffer(t, np.uint64)
            keep = pa.array([may_be_similar(tokens(x), m, tokens(y), n) for x, m, y, n in zip(*columns)], pa.bool_())
            return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

        return work

    def do():
        shingler = Shingler()
        sets = lru_cache(64)(shingler)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            pairs = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            keep = pa.array([similar(sets(x or ""), shingler(y or "")) for x, y in pairs], pa.bool_())
            return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

        return work

    def ids(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        held = only_ids(classes, saved(ids(pairs, "node")), "node")
        side = lambda c: held.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}"))
        likely = saved(map_batches(pairs.join(side("b"), "b").join(side("a"), "a"), can, "a long, b long"))
        if likely.isEmpty():
            return likely
        texts = _texts(docs, classes, saved(ids(likely, "node")))
        texts = saved(texts.groupBy("node").agg(F.min("text").alias("text")))
        text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        found = saved(map_batches(likely.join(text("b"), "b").join(text("a"), "a"), do, "a long, b long"))
        drop_saved(texts)
        return found

    return verify


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, classes of equal sets, and components of the classes with links; all saved.

    Rows are (doc_id, row, n_shingles, set_key): ``row`` is a hash of the text. Classes
    are (set_key, node, doc_id, row), the first row of each. Components are (node, comp).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    sets = saved(token_sets(docs))
    rows = saved(sets.select("doc_id", "row", "n_shingles", "set_key"))
    worded = "set_key is not null and doc_id is not null"
    classes = sets.where(worded).groupBy("set_key").agg(
        F.min(F.struct("doc_id", "row")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.min("tokens").alias("tokens"), F.first("bits").alias("bits")
    )
    # A class goes by the id of its first document, or by a hash where that id has several sets.
    several = rows.where(worded).groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi"))
    several = saved(several.where("lo <> hi").select("doc_id", F.lit(True).alias("several")))
    classes = classes.select("set_key", "one.doc_id", "one.row", "n_shingles", "tokens", "bits").join(several, "doc_id", "left")
    classes = saved(classes.withColumn("node", F.when(F.col("several"), F.xxhash64("set_key")).otherwise(F.col("doc_id"))).drop("several"))
    drop_saved(sets)
    # Sets that need more tokens than are kept with them are read whole; so are the
    # frequent ones of their tokens then known.
    known = frequent_kept(classes)
    share = lambda tokens: spark.sparkContext.broadcast(tokens.tobytes())
    wanting = saved(_wanting(classes, share(known)).distinct())
    frequent = share(np.union1d(known, frequent_whole(_texts(docs, classes, wanting))))
    wanting = saved(_wanting(classes, frequent).distinct())
    whole = _index(_texts(docs, classes, wanting), frequent, whole=True)
    lists = block_lists(_index(classes, frequent, whole=False).unionByName(whole))
    traits = classes.select("node", F.col("n_shingles").alias("n"), "bits")
    found = linked_components(lists, traits, BOUND, _verifier(docs, classes))
    return rows, classes.select("set_key", "node", "doc_id", "row"), found


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    with Scratch(docs.sparkSession) as scratch:
        rows, classes, found = _grouped(docs)
        owner = classes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # Components that an id with several sets has part in are one.
        met = rows.where("doc_id is not null").join(owner.select("set_key", "comp"), "set_key").select("doc_id", "comp")
        met = met.groupBy("doc_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("doc_id")
        met = saved(met)
        if not met.isEmpty():
            nodes = rows.join(met, "doc_id", "left_semi").join(owner.select("set_key", "comp"), "set_key")
            least = nodes.groupBy("doc_id").agg(F.min("comp").alias("a"))
            ties = nodes.join(least, "doc_id").select("a", F.col("comp").alias("b"))
            merged = components(ties).select(F.col("node").alias("comp"), F.col("comp").alias("merged"))
            owner = owner.join(merged, "comp", "left").withColumn("comp", F.coalesce("merged", "comp"))
        least = owner.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        owner = owner.join(least, "comp").select("set_key", "component_id")
        result = rows.join(owner, "set_key", "left").select(
            "doc_id",
            F.col("n_shingles").cast("long").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        return scratch.keep(result)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each component, by doc_id, with all its columns."""
    with Scratch(docs.sparkSession) as scratch:
        rows, classes, found = _grouped(docs)
        linked = classes.join(found, "node")
        stays = linked.groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("one"))
        goes = linked.join(stays, "comp").where(F.struct("doc_id", "row") != F.col("one")).select("set_key")
        # Of a class that stays, the first row does; a row without words always does.
        first = classes.join(goes, "set_key", "left_anti").select("doc_id", "row")
        empty = rows.where("set_key is null and doc_id is not null").select("doc_id", "row")
        kept = scratch.keep(first.unionByName(empty).distinct())
        several = rows.where("doc_id is not null").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
        several = scratch.keep(several.select("doc_id", "row").join(kept, ["doc_id", "row"], "left_semi"))
    whole = docs.select(F.struct("*").alias("all"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"))
    on = lambda ids: (F.col("id") == ids["doc_id"]) & (whole["row"] == ids["row"])
    stay = whole.where("id is null").unionByName(whole.join(kept, on(kept), "left_semi"))
    if not several.isEmpty():
        # Rows equal in id and text: the first by the rest of its columns.
        rest = [f for f in docs.columns if not isinstance(docs.schema[f].dataType, MapType)]
        turn = F.row_number().over(W.partitionBy("id", "row").orderBy(F.xxhash64(*[F.col("all")[f] for f in rest])))
        again = stay.join(several, on(several), "left_semi").withColumn("turn", turn).where("turn = 1").drop("turn")
        alone = stay.where("id is null").unionByName(stay.where("id is not null").join(several, on(several), "left_anti"))
        stay = alone.unionByName(again)
    return stay.select(*[F.col("all")[n].alias(n) for n in docs.columns])
