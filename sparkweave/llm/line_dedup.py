"""Operator 7: line dedup. Of equal and similar lines in all documents the first stays.

Lines are compared lower-cased and with white space collapsed. Equal lines are found
by their key. Of the others, one-permutation MinHash signatures of their character
shingles are banded; lines that meet in a band are verified by the exact Jaccard
similarity of their shingles; components of the links are reduced by a distributed
union-find, and of each the line that comes first, by doc_id, text and line number, stays.

Each line with a word in it is compared, however short; lines without one, which part
paragraphs, stay. A line too short for a shingle can only equal another one. A band equals with a chance of
s^ROWS for lines of similarity s, so of pairs at the bound 1 in about 260 is missed. Bins
that a short line leaves empty are filled independently, so this holds nearly for short
lines too: of 1500 pairs of similarity 0.8 to 0.86 for each of 12 sizes from 5 to 400
shingles, 0.1 to 0.7 % were missed.
Keys are 64-bit hashes: two different lines share one with odds of 2^-64.

All texts are read and normalised once, and of equal lines in a batch one is written
and signed. The keys of its bands are dealt out in blocks, many to a row, and lists of the lines that share one
are formed from the blocks, in pieces of at most PACK lines. Lines that meet are held against each other by sketches
first, whose parity bits prove most of them apart; only the texts of the others travel. Pieces are verified within
one task each; only what the pieces of a list leave unconnected is compared in rounds.

Cases: a null or empty text has no lines to remove; a null doc_id keeps all its lines;
rows that share a doc_id but not the text are documents of their own; rows equal in
both count as one document and are changed alike; a document that
loses all its lines keeps an empty text here and is dropped by the pipeline's stage;
an empty table gives an empty table; other columns are carried along. A long line is
read whole; lists with one of over LONG characters are compared pair by pair in the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import Scratch, map_batches, map_stream, saved
from .linkage import BLOCKS, BROADCAST_IDS, block_lists, components, connect_lists, dealt, n_parts, only_ids, parity_bits

#: Characters of a shingle; the bound in hundredths.
CHARS, BOUND = 5, 80
#: Bins of a signature; bands and rows of each; bins between the rows of a band.
BINS, BANDS, ROWS, STRIDE = 128, 14, 5, 25
#: Characters and lines that are hashed at a time: a line, however short, takes BINS numbers.
CHUNK, CHUNK_LINES = 1 << 17, 512
#: Steps in which empty bins are filled together; bins that look at all others at once after these.
STEPS, LATE = 12, 1 << 13
#: Lines whose bands are dealt into blocks at a time; characters of a line that lists are held in memory with.
DEALT_LINES, LONG = 1 << 14, 1 << 12
#: Lines of a piece of a list; bits of a line's sketch; pairs of sketches that are compared at a time.
PACK, SKETCH, PAIRS = 512, 512, 1 << 16
#: White space other than a space or the end of a line.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
#: Above any value of a bin.
NONE = 1 << 40


def _probes() -> np.ndarray:
    """(BINS, BINS): each bin, then all others in an order of its own."""
    code = np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        code = (code ^ (code >> np.uint64(shift))) * np.uint64(factor)
    code = (code ^ (code >> np.uint64(31))).reshape(BINS, BINS)
    np.fill_diagonal(code, 0)
    return code.argsort(axis=1, kind="stable")


#: Where an empty bin takes its value from. Were it the next bin, the bins of a short
#: line, of which few are filled, would copy each other, and its bands would meet or
#: fail together.
PROBES = _probes()


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """The normal form of each line."""
    lines = text.lower().split("\n")
    if ODD_SPACE.search(text):
        return [" ".join(line.split()) for line in lines]
    return [" ".join(x.split()) if "  " in x or x[:1] == " " or x[-1:] == " " else x for x in lines]


def key_of(line: str) -> int:
    n = xxhash.xxh3_64_intdigest(line)
    return n - (1 << 64) if n >> 63 else n


def shingle_codes(text: str) -> np.ndarray:
    """A 64-bit code of each run of CHARS code points; equal codes, equal runs but for odds of 2^-64."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(points) - CHARS + 1)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(CHARS, len(points))):
            code += points[k : k + n]
            code *= np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BINS) least code of each bin, an empty bin filled from the first of its PROBES that isn't."""
    codes = shingle_codes("\n".join(lines))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(0, len(lines) * BINS, BINS), sizes + 1)[: len(codes)]
    value = codes >> np.uint64(20)
    value &= np.uint64(0xFFFFFFFF)
    value = value.view(np.int64)
    # Runs that reach over a line's end don't count.
    for k in range(1, CHARS + 1):
        over = ends - k
        value[over[(over < len(value)) & (over >= 0)]] = NONE
    table = np.full(len(lines) * BINS, NONE, np.int64)
    owner += (codes >> np.uint64(64 - 7)).view(np.int64)
    np.minimum.at(table, owner, value)
    table[table == NONE] = -1
    table = table.reshape(len(lines), BINS)
    # Only the bins that bands read are filled; a line without a run keeps -1.
    row, col = np.nonzero(table[:, : STRIDE * (ROWS - 1) + BANDS] < 0)
    some = (table >= 0).any(axis=1)[row]
    row, col = row[some], col[some]
    out = table.copy()
    for step in range(1, STEPS):
        if not len(row):
            break
        found = table[row, PROBES[col, step]]
        hit = found >= 0
        out[row[hit], col[hit]] = found[hit]
        row, col = row[~hit], col[~hit]
    # What is left, of lines with few filled bins, looks at all other bins at once.
    for at in range(0, len(row), LATE):
        r, c = row[at : at + LATE], col[at : at + LATE]
        found = table[r[:, None], PROBES[c, STEPS:]]
        out[r, c] = found[np.arange(len(r)), (found >= 0).argmax(axis=1)]
    return out


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys: equal where all rows of a band are."""
    table = np.ascontiguousarray(signatures(lines).view(np.uint64).T)
    out = np.empty((len(lines), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(lines), np.uint64(b + 1))
            for r in range(ROWS):
                key = (key ^ table[b + STRIDE * r]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, b] = key
    return out.view(np.int64)


def code_set(text: str) -> np.ndarray:
    codes = np.sort(shingle_codes(text))
    return codes[np.r_[True, codes[1:] != codes[:-1]]]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of codes, each sorted, reach the bound."""
    if 100 * min(len(x), len(y)) < BOUND * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= BOUND * (len(both) - shared)


def jaccard_reaches(a: str, b: str) -> bool:
    return similar(code_set(a), code_set(b))


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row, line and key of each line with a word; the first of equal ones in a batch has their number and text."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            order, text_of = np.lexsort((rows, ids)), batch.column("text").to_pylist()
            sizes, numbers, keys, texts, n = [], [], [], [], []
            seen: dict[int, int] = {}
            for r in order.tolist():
                before = len(keys)
                for i, line in enumerate(normal_lines(text_of[r])):
                    if not line:
                        continue
                    key = key_of(line)
                    first = seen.setdefault(key, len(keys))
                    if first < len(keys):
                        n[first] += 1
                    fresh = first == len(keys)
                    numbers.append(i)
                    keys.append(key)
                    texts.append(line if fresh else None)
                    n.append(int(fresh))
                sizes.append(len(keys) - before)
            return {"doc_id": np.repeat(ids[order], sizes), "row": np.repeat(rows[order], sizes), "line": numbers, "key": keys, "n": n, "text": texts}

        return work

    whole = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    return map_batches(whole, make, "doc_id long, row long, line int, key long, n int, text string")


def _banded(lines: DataFrame) -> DataFrame:
    """The band keys of each line with a shingle, in blocks."""
    parts = n_parts(lines.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        keys, nodes, held = [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            long_enough = [i for i, t in enumerate(texts) if len(t) >= CHARS]
            part, size = [], 0
            for i in [*long_enough, None]:
                if part and (i is None or size > CHUNK or len(part) >= CHUNK_LINES):
                    keys.append(band_keys(part).ravel())
                    part, size = [], 0
                if i is not None:
                    part.append(texts[i])
                    size += len(texts[i])
            nodes.append(np.repeat(batch.column("key").to_numpy()[long_enough], BANDS))
            held += len(long_enough)
            if held >= DEALT_LINES:
                yield dealt(np.concatenate(keys), np.concatenate(nodes), parts)
                keys, nodes, held = [], [], 0
        if held:
            yield dealt(np.concatenate(keys), np.concatenate(nodes), parts)

    return map_stream(lines.select("key", "text"), make, BLOCKS)


def groups_of(sets: list[np.ndarray]) -> list[list[int]]:
    """The components of the sets by links between similar ones; of two sets apart each pair was compared."""
    groups: list[list[int]] = []
    for i, x in enumerate(sets):
        own, others = [i], []
        for group in groups:
            if any(similar(sets[j], x) for j in group):
                own = group + own
            else:
                others.append(group)
        groups = [*others, own]
    return groups


def code_sets(texts: list[str]) -> list[np.ndarray]:
    """The sets of lines that each have a shingle."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        codes, sides, start = shingle_codes("\n".join(texts[at:end])), [], 0
        for text in texts[at:end]:
            sides.append((start, start + len(text) - CHARS + 1))
            codes[start : sides[-1][1]].sort()
            start += len(text) + 1
        new = np.r_[True, codes[1:] != codes[:-1]]
        new[[a for a, _ in sides]] = True
        out += [codes[a:b][new[a:b]] for a, b in sides]
        at = end
    return out


def sketches_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and sketches of the sets of lines that each have a shingle; the sets aren't made one by one.

    Beside a line's number, 55 bits of a code are sorted: of a line of LONG characters
    two shingles are taken for one with odds of 2^-32.
    """
    sizes, bits, at = [np.zeros(0, np.int64)], [np.zeros((0, SKETCH // 64), np.uint64)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < CHUNK_LINES and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        codes, n = shingle_codes("\n".join(texts[at:end])), end - at
        lengths = np.fromiter(map(len, texts[at:end]), np.int64, n)
        # Runs that reach over a line's end don't count.
        real = np.ones(len(codes) + CHARS, bool)
        real[(np.cumsum(lengths + 1)[:, None] - np.arange(1, CHARS + 1)).ravel()] = False
        owner = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(55), lengths - CHARS + 1)
        codes = owner | (codes[real[: len(codes)]] & np.uint64((1 << 55) - 1))
        codes.sort()
        codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
        row = (codes >> np.uint64(55)).view(np.int64)
        sizes.append(np.bincount(row, minlength=n))
        odd = np.bincount(row * SKETCH + (codes & np.uint64(SKETCH - 1)).view(np.int64), minlength=n * SKETCH).astype(np.uint8) & 1
        bits.append(np.packbits(odd).view(np.uint64).reshape(n, SKETCH // 64))
        at = end
    return np.concatenate(sizes), np.concatenate(bits)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SKETCH / 64) parity bits of the low bits of the codes: sets whose sketches differ in d places differ by d codes or more."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(SKETCH - 1)
    at = at.astype(np.int64) + np.repeat(np.arange(len(sets)) * SKETCH, sizes)
    odd = np.bincount(at, minlength=len(sets) * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64).reshape(len(sets), SKETCH // 64)


def may_meet(group: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which rows have another one of their group, groups being runs, that sizes ``n`` and sketches don't prove less than similar."""
    kept = np.zeros(len(group), bool)
    if not len(group):
        return kept
    rows = np.arange(len(group))
    more = np.searchsorted(group, group, side="right") - rows - 1
    run = np.cumsum(more) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(group)]
    for a, b in zip(cuts, cuts[1:]):
        i = np.repeat(rows[a:b], more[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[a:b]) - more[a:b], more[a:b])
        open_ = ~(kept[i] & kept[j]) & (100 * np.minimum(n[i], n[j]) >= BOUND * np.maximum(n[i], n[j]))
        i, j = i[open_], j[open_]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = differ * (100 + BOUND) <= (n[i] + n[j]) * (100 - BOUND)
        kept[i[near]] = kept[j[near]] = True
    return kept


def _sketched(lines: DataFrame) -> DataFrame:
    """node, n, bits: size and sketch of the shingles of these lines; n is 0 for a line over LONG characters, which has none."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            texts = batch.column("text").to_pylist()
            short = np.fromiter((len(t) <= LONG for t in texts), bool, len(texts))
            n, bits = np.zeros(len(texts), np.int32), np.full(len(texts), None)
            n[short], found = sketches_of([t for t in texts if len(t) <= LONG])
            bits[short] = [row.tobytes() for row in found]
            return {"node": batch.column("node"), "n": n, "bits": bits}

        return work

    return map_batches(lines, make, "node long, n int, bits binary")


def _under_heads(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of nodes by each head of theirs, sorted by head and node; equal ones may be there several times."""
    few = members.count() <= BROADCAST_IDS
    met = rows.join(F.broadcast(members), "node") if few else rows.dropDuplicates(["node"]).join(members, "node")
    return met.repartition("head").sortWithinPartitions("head", "node")


def _fresh(head: np.ndarray, node: np.ndarray, before: tuple[int, int] | None = None) -> np.ndarray:
    """Which of the sorted rows aren't as the one before."""
    fresh = np.r_[True, (head[1:] != head[:-1]) | (node[1:] != node[:-1])][: len(head)]
    fresh[:1] &= before is None or len(head) == 0 or (head[0], node[0]) != before
    return fresh


def _meeting(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """Of the rows (head, node) those whose line may be similar to another one of the head; saved. Lines over LONG characters are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH // 64), np.uint64)]
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            held = list(map(np.concatenate, zip(held, [*(batch.column(c).to_numpy() for c in ("head", "node", "n")), bits])))
            end = np.searchsorted(held[0], held[0][-1])  # the last group may go on
            if end:
                yield near(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        yield near(*held)

    def near(head: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray) -> dict[str, list]:
        fresh = _fresh(head, node)
        head, node, n, bits = head[fresh], node[fresh], n[fresh], bits[fresh]
        kept = may_meet(head, n, bits)
        return {"head": head[kept], "node": node[kept]}

    return saved(map_stream(_under_heads(members, sketched.where("n > 0")), work, "head long, node long"))


def _links(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): components among the nodes of each head (head, node), as stars."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        head, nodes, sets, before = None, [], [], None

        def links() -> list[tuple[int, int]]:
            groups = [[nodes[i] for i in group] for group in groups_of(sets)]
            return [(least, node) for group in groups for least in [min(group)] for node in group if node != least]

        for batch in batches:
            heads, own, found = batch.column("head").to_numpy(), batch.column("node").to_numpy(), []
            fresh = _fresh(heads, own, before)
            before = heads[-1], own[-1]
            heads, own = heads[fresh], own[fresh]
            held = code_sets(batch.column("text").filter(pa.array(fresh)).to_pylist())
            starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]][: len(heads)]).tolist()
            for a, b in zip(starts, [*starts[1:], len(heads)]):
                if heads[a] != head:
                    found += links()
                    head, nodes, sets = heads[a], [], []
                nodes += own[a:b].tolist()
                sets += held[a:b]
            yield {"a": [x for x, _ in found], "b": [y for _, y in found]}
        found = links()
        yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return map_stream(_under_heads(members, lines), make, "a long, b long")


def _traits(texts: DataFrame) -> DataFrame:
    """node, n, bits: size and parity bits of the shingles of these lines."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            sets = list(map(code_set, batch.column("text").to_pylist()))
            return {"node": batch.column("node"), "n": list(map(len, sets)), "bits": list(map(parity_bits, sets))}

        return work

    return map_batches(texts, make, "node long, n int, bits array<long>")


def _verifier(texts: DataFrame):
    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            pairs = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            keep = pa.array([jaccard_reaches(x, y) for x, y in pairs], pa.bool_())
            return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

        return work

    def verify(pairs: DataFrame) -> DataFrame:
        ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        held = only_ids(texts.select("node", "text"), ids, "node")
        text = lambda c: held.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(text("b"), "b").join(text("a"), "a")
        return saved(map_batches(both, make, "a long, b long"))

    return verify


def _headed(packed: DataFrame) -> DataFrame:
    """(list_id, first_rank, nodes, anchor, head) of the pieces; saved.

    ``anchor``: the first node of a list, in its later pieces, which all have it beside
    their own nodes. ``head``: of the piece's own nodes the one in most pieces, as its
    rank, less for more, and its id. An original is in more lists than its altered
    copies, which have fewer neighbours each, so most lists of a group have one head.
    """
    later = F.col("first_rank") > 0
    nodes = F.when(later, F.slice("nodes", 2, F.greatest(F.lit(0), F.size("nodes") - 1))).otherwise(F.col("nodes"))
    members = packed.select("list_id", "first_rank", F.when(later, F.get("nodes", 0)).alias("anchor"), F.explode(nodes).alias("node"))
    ranked = F.collect_list(F.struct("rank", "node")).alias("ranked")
    members = members.withColumn("rank", -F.count("*").over(W.partitionBy("node")))  # a node is in BANDS lists at most
    pieces = members.groupBy("list_id", "first_rank").agg(ranked, F.max("anchor").alias("anchor"))
    return saved(pieces.select("list_id", "first_rank", "anchor", F.array_min("ranked").alias("head"), F.transform("ranked", lambda r: r["node"]).alias("nodes")))


def _all_nodes() -> Column:
    return F.concat("nodes", F.array_compact(F.array("anchor")))


def _unfinished(pieces: DataFrame, own: DataFrame, comps: DataFrame) -> DataFrame:
    """(list_id, first_rank) of the pieces with nodes that are neither connected nor were all compared under their head."""
    at = own.join(comps, "node", "left").select("node", F.col("head").alias("own"), F.coalesce("comp", "node").alias("comp"))
    members = pieces.select("list_id", "first_rank", "anchor", F.col("head.node").alias("head"), F.explode(_all_nodes()).alias("node")).join(at, "node")
    met = (F.col("own") == F.col("head")) | (F.col("node") == F.col("head")) | F.col("node").eqNullSafe(F.col("anchor"))
    held = members.groupBy("list_id", "first_rank").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max((~met).cast("int")).alias("apart"))
    return held.where("lo <> hi and apart = 1").select("list_id", "first_rank")


def linked_lines(lines: DataFrame) -> DataFrame:
    """(node, comp) of the lines (key, text) with a similar one, equal ones in any number; saved.

    First each node is compared under the first of its pieces' heads, with all nodes
    that have the same one: a group of near copies has nearly all of its lists in common
    with one head, and so each text travels about once. Then the pieces that this leaves
    unconnected are compared, under each head. A head has at most BANDS times PACK nodes,
    and an anchor for each PACK of them, for a line is in one list of each band.
    """
    packed = block_lists(_banded(lines), PACK)
    pieces = _headed(packed)
    named = lines.select(F.col("key").alias("node"), "text")
    text_of = lambda nodes: only_ids(named, nodes, "node").groupBy("node").agg(F.min("text").alias("text"))
    own = pieces.select("head", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("head")["node"].alias("head"))
    own = saved(own.select("head", "node"))
    heads = own.select("head", F.col("head").alias("node"))
    anchors = pieces.where("anchor is not null").select(F.col("head.node").alias("head"), F.col("anchor").alias("node"))
    sketched = saved(_sketched(only_ids(named, own.select("node"), "node")))
    linked = lambda members: _links(_meeting(saved(members.distinct()), sketched), named)
    comps = components(linked(own.unionByName(heads).unionByName(anchors)))
    rest = saved(pieces.join(_unfinished(pieces, own, comps), ["list_id", "first_rank"], "left_semi"))
    if not rest.isEmpty():
        more = linked(rest.select(F.col("head.node").alias("head"), F.explode(_all_nodes()).alias("node")))
        stars = comps.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))
        comps = components(stars.unionByName(more))
    # Lists in several pieces, or with very long lines, may have more links.
    long_lines = saved(sketched.where("n = 0").select("node").distinct())
    members = packed.select("list_id", F.explode("nodes").alias("node"))
    more = packed.where("first_rank > 0").select("list_id").unionByName(only_ids(members, long_lines, "node").select("list_id"))
    more = saved(more.distinct())
    if more.isEmpty():
        return comps
    left = saved(members.join(more, "list_id", "left_semi").distinct())
    texts = saved(text_of(saved(left.select("node").distinct())))
    return connect_lists(saved(left.join(_traits(texts), "node")), comps, BOUND, _verifier(texts), quick_rounds=2)


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, exact, fuzzy: the numbers of its lines to remove, equal to an earlier line or similar to one; saved.

    ``row`` is a hash of the text: rows that share a doc_id are told apart by it.
    """
    with Scratch(docs.sparkSession) as scratch:
        occurrences = saved(_occurrences(docs.select("doc_id", "text")))
        first = F.min(F.struct("doc_id", "row", "line")).alias("first")
        firsts = saved(occurrences.where("n > 0").groupBy("key").agg(first, F.sum("n").alias("n")))
        found = linked_lines(occurrences.where("n > 0").select("key", "text")).withColumnRenamed("node", "key")
        # Only lines that occur twice or have a link can go.
        owned = saved(firsts.join(found, "key", "left").where("n > 1 or comp is not null").select("key", "first", "comp"))
        stays = owned.where("comp is not null").groupBy("comp").agg(F.min("first").alias("stays"))
        where = owned.join(stays, "comp", "left").select("key", "first", F.coalesce("stays", "first").alias("stays"))
        judged = occurrences.select("doc_id", "row", "line", "key").join(where, "key").withColumn("here", F.struct("doc_id", "row", "line"))
        gone = judged.where(F.col("here") != F.col("stays"))
        exact = F.col("here") != F.col("first")
        return scratch.keep(
            gone.groupBy("doc_id", "row").agg(
                F.array_sort(F.collect_set(F.when(exact, F.col("line")))).alias("exact"),
                F.array_sort(F.collect_set(F.when(~exact, F.col("line")))).alias("fuzzy"),
            )
        )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact, n_fuzzy and removed, the numbers of the removed lines, of each document."""
    gone = removed_lines(docs)
    none = F.array().cast("array<int>")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    counted = docs.select("doc_id", F.xxhash64("text").alias("row"), n_lines.alias("n_lines"))
    both = counted.join(gone, ["doc_id", "row"], "left")
    exact, fuzzy = F.coalesce("exact", none), F.coalesce("fuzzy", none)
    return both.select(
        "doc_id", "n_lines", F.size(exact).cast("long").alias("n_exact"), F.size(fuzzy).cast("long").alias("n_fuzzy"),
        F.array_sort(F.concat(exact, fuzzy)).alias("removed"),
    )


def without_repeats(docs: DataFrame, drop_empty: bool = True) -> DataFrame:
    """The documents without the removed lines, with all their columns; a document left without words goes."""
    names = docs.columns
    gone = removed_lines(docs).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), F.concat("exact", "fuzzy").alias("gone_lines"))
    rows = docs.select(F.struct("*").alias("all"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"))
    rows = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    lines = F.filter(F.split("all.text", "\n"), lambda _, i: ~F.array_contains("gone_lines", i))
    text = F.when(F.col("gone_lines").isNull(), F.col("all.text")).otherwise(F.array_join(lines, "\n"))
    out = rows.withColumn("new_text", text)
    if drop_empty:
        out = out.where(F.col("gone_lines").isNull() | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("new_text").alias("text") if n == "text" else F.col("all")[n].alias(n) for n in names])


def with_new_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the text's length now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
