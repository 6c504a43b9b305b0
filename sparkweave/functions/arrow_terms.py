"""Terms of blocks of texts as 64-bit keys on Arrow tables, where postings are too many to be rows.

A text is a list of lines, a line a list of its words' keys. Its terms are its words and the pairs of
neighbours that the filter both keeps; ``dropped`` are the keys of words that it doesn't, sorted. Numbers
of one kind travel as bytes, those of asks and answers packed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_vectors import rounded

#: Products that are held at once.
PRODUCTS = 1 << 21
#: Low bytes of the steps between sorted keys, which are as good as random and are not compressed.
RANDOM = 5


def packed(x: np.ndarray, raw: int = 0) -> bytes:
    """64-bit numbers by bytes of one weight, of which the lowest ``raw`` are as they are, the others compressed, none above the largest number's."""
    x = x.astype("<u8")
    width = max(raw, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8).T
    high = planes[raw:width].tobytes()
    return np.array([len(x), raw, width], "<u4").tobytes() + planes[:raw].tobytes() + (pa.compress(high, "zstd", asbytes=True) if high else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, raw, width = np.frombuffer(data, "<u4", 3).tolist()
    planes = np.zeros((8, n), np.uint8)
    planes[:raw] = np.frombuffer(data, np.uint8, raw * n, 12).reshape(raw, n)
    if n and width > raw:
        high = pa.decompress(data[12 + raw * n :], (width - raw) * n, "zstd", asbytes=True)
        planes[raw:width] = np.frombuffer(high, np.uint8).reshape(width - raw, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by the steps between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)), RANDOM)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of two words in this order."""
    return _mixed(_mixed(a + np.uint64(0x9E3779B97F4A7C15)) + b)


class Terms:
    """The distinct terms of a block by unit: a line of an id, where rows with one id and equal line numbers are one.

    Units are numbered by id, nulls first, and line. ``unit``, ``term`` and ``tf`` are
    sorted by unit and term; ``vocab`` has the terms' keys.
    """

    def __init__(self, table: pa.Table, dropped: np.ndarray):
        ids = table["id"].combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        known = pc.unique(ids.drop_null())
        known = known.take(pc.sort_indices(known))
        code = pc.fill_null(pc.index_in(ids, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.ids = pa.concat_arrays([pa.nulls(1, ids.type), known])
        texts = pa.concat_arrays(table["words"].chunks) if table.num_rows else table["words"].combine_chunks()
        n_lines = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        lines = texts.flatten()
        n_words = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lines.flatten()
        most = np.zeros(len(self.ids), np.int64)
        np.maximum.at(most, code, n_lines)
        self.base = np.concatenate([[0], np.cumsum(most)])
        number = np.arange(len(lines)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        of_line = np.repeat(self.base[code], n_lines) + number
        unit, line = np.repeat(of_line, n_words), np.repeat(np.arange(len(lines)), n_words)
        key = words.to_numpy(zero_copy_only=False)
        kept = dropped[np.minimum(np.searchsorted(dropped, key), len(dropped) - 1)] != key
        key = key.view(np.uint64)
        both = kept[:-1] & kept[1:] & (line[:-1] == line[1:])
        keys = np.concatenate([key[kept], _pair(key[:-1][both], key[1:][both])])
        units = np.concatenate([unit[kept], unit[:-1][both]])
        term, found = pd.factorize(keys)
        order = np.argsort(found)
        self.vocab, place = found[order], np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        term = place[term]
        n = max(1, len(self.vocab))
        self.at, self.tf = np.unique(units * n + term, return_counts=True)
        self.unit, self.term = np.divmod(self.at, n)
        self.n_units = int(self.base[-1])

    def owner(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``ids`` and the line number from 0."""
        code = np.searchsorted(self.base, unit, side="right") - 1
        return code, unit - self.base[code]

    def dealt(self, buckets: int):
        """Bounds of the buckets, which are ranges of keys, so that steps between a bucket's keys are small."""
        own = (self.vocab >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(own, np.arange(buckets + 1).astype(np.uint64))

    def frequencies(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """The answers to what ``ask`` asked, in the order of ``vocab``."""
        bounds = self.dealt(buckets)
        df = np.zeros(len(self.vocab), np.int64)
        for b, found in zip(answers["bucket"].to_pylist(), answers["dfs"]):
            if b >= 0:
                df[bounds[b] : bounds[b + 1]] = unpacked(found.as_py())
        return df


def ask(buckets: int, dropped: np.ndarray):
    """A function of a block's table: its terms' keys and in how many of its units each is, by bucket of keys.

    Blocks below 0 hold questions, which want to know and count for nothing.
    """

    def one(table: pa.Table) -> pa.Table:
        terms, block = Terms(table, dropped), table["block"][0].as_py()
        counts = np.bincount(terms.term, minlength=len(terms.vocab)) * (block >= 0)
        bounds = terms.dealt(buckets)
        parts = [(b, slice(x, y)) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
        return pa.table({
            "block": pa.array([block] * len(parts), pa.int32()), "bucket": pa.array([b for b, _ in parts], pa.int32()),
            "keys": pa.array([packed_keys(terms.vocab[p]) for _, p in parts], pa.binary()),
            "counts": pa.array([packed(counts[p]) for _, p in parts], pa.binary()),
        })

    return one


def answer(table: pa.Table) -> pa.Table:
    """Of a bucket's asks: in how many units of all blocks each of the keys is."""
    keys = [unpacked_keys(k.as_py()) for k in table["keys"]]
    counts = np.concatenate([unpacked(c.as_py()).astype(np.int64) for c in table["counts"]])
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at, counts)
    ends = np.cumsum([len(k) for k in keys])
    dfs = [packed(total[at[end - len(k) : end]]) for k, end in zip(keys, ends)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "dfs": pa.array(dfs, pa.binary())})


def answer_questions(held: pa.Table, asked: pa.Table) -> pa.Table:
    """A bucket's answers to the questions among its asks, which come by themselves."""
    if not asked.num_rows:
        return pa.table([pa.nulls(0, kind) for kind in (pa.int32(), pa.int32(), pa.binary())], names=["block", "bucket", "dfs"])
    return answer(pa.concat_tables([asked, held])).slice(0, asked.num_rows)


def smooth_weights(terms: Terms, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """tf * idf with the smooth idf, scaled to length 1 in each unit; of terms that the corpus has."""
    at = np.flatnonzero(df[terms.term] > 0)
    unit = terms.unit[at]
    raw = terms.tf[at] * (np.log((1 + n) / (1 + df[terms.term[at]])) + 1)
    norm = np.sqrt(np.bincount(unit, raw * raw, minlength=terms.n_units))
    return at, raw / norm[unit]


def first_line_products(buckets: int, n: int, dropped: np.ndarray):
    """A function of a block and its answers: the inner product of each line with its id's first line, if they share a term."""

    def cell(table: pa.Table, answers: pa.Table) -> pa.Table:
        terms = Terms(table, dropped)
        _, weight = smooth_weights(terms, terms.frequencies(answers, buckets), n)  # an own term's df is 1 at least
        code, number = terms.owner(terms.unit)
        want = terms.base[code] * max(1, len(terms.vocab)) + terms.term
        place = np.minimum(np.searchsorted(terms.at, want), max(0, len(terms.at) - 1))
        met = np.flatnonzero((terms.at[place] == want) & (number > 0) & (code > 0)) if len(want) else np.zeros(0, np.int64)
        unit, at = np.unique(terms.unit[met], return_inverse=True)
        product = np.bincount(at, weight[met] * weight[place[met]], minlength=len(unit))
        code, number = terms.owner(unit)
        return pa.table({"id": terms.ids.take(pa.array(code)), "i": pa.array(number + 1, pa.int64()), "product": pa.array(product, pa.float64())})

    return cell


def log_weights(terms: Terms, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """ln(1 + tf) * idf; of terms of weight above 0 that the corpus has."""
    idf = np.where(df > 0, np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1.0)), 0.0)
    at = np.flatnonzero(idf[terms.term] > 0)
    return at, np.log1p(terms.tf[at]) * idf[terms.term[at]]


def pack(buckets: int, n: int, weigh, dropped: np.ndarray):
    """A function of a block of questions and its answers: one row with all their weighted terms."""

    def one(table: pa.Table, answers: pa.Table) -> pa.Table:
        terms = Terms(table, dropped)
        at, weight = weigh(terms, terms.frequencies(answers, buckets), n)
        at, weight = at[order := np.argsort(terms.term[at], kind="stable")], weight[order]
        code, _ = terms.owner(terms.unit[at])
        own, place = np.unique(code, return_inverse=True)
        qids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), terms.ids.take(pa.array(own)))
        bytes_ = lambda x: pa.array([x.tobytes()], pa.binary())
        columns = [pa.array([-1], pa.int32()), qids, bytes_(place.astype(np.int64)), bytes_(terms.vocab[terms.term[at]]), bytes_(weight)]
        return pa.table(columns, names=["bucket", "qids", "places", "keys", "weights"])

    return one


def _runs(cost: np.ndarray):
    """Bounds of runs of about PRODUCTS in cost, of one unit at least."""
    run = np.cumsum(cost) // PRODUCTS
    return [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(cost)] if len(cost) else [0]


def best(buckets: int, n: int, k: int, weigh, far: bool, dropped: np.ndarray, digits: int = 6):
    """A function of a block and of its answers and the packed questions: of each question the k best units that share a term.

    The best have the smallest rounded 1 - product if ``far``, else the largest rounded product; ties go to the smaller unit.
    Rows with a ``wanted`` id and question ask for the product of the id's first unit; it comes besides, flagged.
    """

    names = ["qid", "id", "i", "product", "wanted"]

    def cut(unit: np.ndarray, q: np.ndarray, x: np.ndarray):
        value = rounded(1 - x, digits) if far else -rounded(x, digits)
        order = np.lexsort((unit, value, q))
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
        return unit[order], q[order], x[order]

    def asked(terms: Terms, at: np.ndarray, weight: np.ndarray, nq: int, places: np.ndarray, keys: np.ndarray, weights: np.ndarray, wanted):
        known, start, count = np.unique(keys, return_index=True, return_counts=True)  # keys come sorted
        place = np.minimum(np.searchsorted(known, terms.vocab), max(0, len(known) - 1))
        held = known[place] == terms.vocab if len(known) else np.zeros(len(terms.vocab), bool)
        met = held[terms.term[at]]
        unit, term, weight = terms.unit[at[met]], place[terms.term[at[met]]], weight[met]
        units, first = np.unique(unit, return_index=True)
        ends = np.append(first, len(unit))[1:]
        share = np.concatenate([[0], np.cumsum(count[term])])
        bounds = _runs(share[ends] - share[first] + nq)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        least, besides = np.zeros(nq), [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        for a, b in zip(bounds, bounds[1:]):
            own = slice(first[a], ends[b - 1])
            times = count[term[own]]
            each = np.repeat(np.arange(len(times)), times)
            at_q = np.repeat(start[term[own]], times) + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            row = np.searchsorted(units[a:b], unit[own])[each]
            x = np.bincount(row * nq + places[at_q], weight[own][each] * weights[at_q], minlength=(b - a) * nq).reshape(b - a, nq)
            here = np.isin(wanted[0], units[a:b])
            i, j = np.searchsorted(units[a:b], wanted[0][here]), wanted[1][here]
            besides.append([wanted[0][here][x[i, j] > 0], j[x[i, j] > 0], x[i, j][x[i, j] > 0]])
            if b - a > k:
                least = np.maximum(least, np.partition(x, b - a - k, axis=0)[b - a - k])
            # Rounding moves a product by half a digit, another order of adding by far less.
            i, j = np.nonzero((x > 0) & (x >= least - 2 * 10.0**-digits - 1e-9 * least))
            found = cut(*map(np.concatenate, zip(found, (units[a + i], j, x[i, j]))))
        return found, [np.concatenate(c) for c in zip(*besides)]

    def wants(terms: Terms, right: pa.Table, qids: pa.Array):
        """Units and places of questions that are wanted."""
        rows = right.filter(pc.equal(right["bucket"], -2))
        code = pc.fill_null(pc.index_in(rows["wid"], value_set=terms.ids), -1).to_numpy().astype(np.int64)
        place = pc.fill_null(pc.index_in(rows["wqid"], value_set=qids), -1).to_numpy().astype(np.int64)
        both = (code > 0) & (place >= 0)
        return terms.base[code[both]], place[both]

    def cell(table: pa.Table, right: pa.Table) -> pa.Table:
        terms = Terms(table, dropped)
        at, weight = weigh(terms, terms.frequencies(right, buckets), n)
        parts = []
        for row in np.flatnonzero(np.asarray(right["bucket"]) == -1) if table.num_rows else []:
            qids = right["qids"][int(row)].values
            of = lambda c, kind: np.frombuffer(right[c][int(row)].as_py(), kind)
            lists = of("places", np.int64), of("keys", np.uint64), of("weights", np.float64)
            for flag, (unit, q, x) in zip((False, True), asked(terms, at, weight, len(qids), *lists, wants(terms, right, qids))):
                code, number = terms.owner(unit)
                columns = [qids.take(pa.array(q)), terms.ids.take(pa.array(code)), pa.array(number + 1, pa.int64()), pa.array(x, pa.float64())]
                parts.append(pa.table([*columns, pa.array(np.full(len(q), flag))], names=names))
        none = [pa.nulls(0, kind) for kind in (right["qids"].type.value_type, terms.ids.type, pa.int64(), pa.float64(), pa.bool_())]
        return pa.concat_tables([pa.table(none, names=names), *parts])

    return cell
