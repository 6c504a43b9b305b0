"""Operator 5: licence scans.

A text's words, lower-cased and without punctuation, are compared with licence
templates by the Dice coefficient of their word bigrams, as multisets. Candidates are
all runs of words that begin and end with a bigram of the template, wherever sentences
end, since a run is never less similar without ends that share none. Of them only
those are tried whose number of bigrams can reach the bound.

A run that reaches the bound shares two thirds of the template's bigrams. Of any third
and one more it so holds one: a template of whose rarest a text holds none is skipped.

Cases: a null or empty text matches nothing; equal texts get equal results; of
templates with equal coefficients the longest stands, and of these the first; overlapping matches give way to
the better one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_batches, texts_of
from .license_templates import TEMPLATES

#: The least coefficient of a match, in hundredths.
BOUND = 80
WORD = re.compile(r"[^\W_]+")
#: Frequent words: bigrams of them are taken as rare last.
FREQUENT = frozenset("a an and any as be by for from in is it may not of on or such that the this to under with you".split())

SCHEMA = (
    "doc_id long, license string, dice double, n_matches long, licenses array<string>, dices array<double>, "
    "starts array<int>, ends array<int>"
)


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: Counter
    size: int

    def least(self) -> int:
        """Least number of shared bigrams of a run that can reach the bound."""
        return -(-self.size * BOUND // (200 - BOUND))

    def most(self) -> int:
        """Greatest number of bigrams of a run that can reach the bound."""
        return self.size * (200 - BOUND) // BOUND


class Hits:
    """Where a text has a template's bigrams, and of which runs of them each is shared."""

    def __init__(self, template: Template, bigrams: list[tuple[str, str]]):
        self.template = template
        at, back = [], []
        seen: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, b in enumerate(bigrams):
            if count := template.bigrams.get(b):
                own = seen[b]
                # Of a run, the last ``count`` of equal bigrams are shared: not this one if so many are before it.
                back.append(own[-count] if len(own) >= count else -1)
                own.append(len(at))
                at.append(i)
        self.at, self.back = np.array(at, np.int64), np.array(back, np.int64)

    def starts(self) -> list[int]:
        """The hits after which so many follow, so near, that a run from there may reach the bound."""
        need = self.template.least()
        if len(self.at) < need:
            return []
        return np.flatnonzero(self.at[need - 1 :] - self.at[: len(self.at) - need + 1] < self.template.most()).tolist()

    def best(self, start: int, limit: int) -> tuple[float, int] | None:
        """The best run's coefficient and last word, of those from a hit that reach the bound before a word."""
        first = self.at[start]
        end = int(np.searchsorted(self.at, min(first + self.template.most(), limit - 1)))
        if end - start < self.template.least():
            return None
        # Equal bigrams within the run are shared up to the template's number of them.
        shared = np.cumsum(self.back[start:end] < start)
        both = self.at[start:end] - first + 1 + self.template.size
        dice = 2 * shared / both
        j = int(dice.argmax())
        if 200 * int(shared[j]) < BOUND * int(both[j]):
            return None
        return float(dice[j]), int(self.at[start + j]) + 1


class Scanner:
    """Finds the licence texts in a text."""

    def __init__(self, templates=TEMPLATES):
        self.templates = []
        for name, text in templates:
            words = WORD.findall(text.lower())
            self.templates.append(Template(name, Counter(zip(words, words[1:])), len(words) - 1))
        held = Counter(b for t in self.templates for b in t.bigrams)
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            spare = t.size - t.least()
            for b in sorted(t.bigrams, key=lambda b: (len(FREQUENT.intersection(b)), held[b], b)):
                self.holders[b].append(i)
                spare -= t.bigrams[b]
                if spare < 0:
                    break

    def __call__(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, coefficient) of the matches, code points, by start."""
        words = WORD.findall(text.lower())
        # Lower case can change a text's length; positions need words of the text itself.
        return self._matches(text) if not self.holders.keys().isdisjoint(zip(words, words[1:])) else []

    def _matches(self, text: str) -> list[tuple[int, int, str, float]]:
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        bigrams = list(zip(words, words[1:]))
        queue, hits = [], {}

        def put(t: int, start: int, limit: int) -> None:
            if found := hits[t].best(start, limit):
                heapq.heappush(queue, (-found[0], -self.templates[t].size, t, start, found[1]))

        for t in sorted({t for b in self.holders.keys() & set(bigrams) for t in self.holders[b]}):
            hits[t] = Hits(self.templates[t], bigrams)
            for start in hits[t].starts():
                put(t, start, len(words))
        kept: list[tuple[int, int, int, float]] = []  # first word, last word, template, coefficient
        while queue:
            dice, _, t, start, last = heapq.heappop(queue)
            first = int(hits[t].at[start])
            at = bisect(kept, (first, len(words)))
            if at and kept[at - 1][1] >= first:
                continue
            if at < len(kept) and kept[at][0] <= last:  # a shorter run may do
                put(t, start, kept[at][0])
                continue
            kept.insert(at, (first, last, t, round(-dice, 6)))
        return [(spans[a][0], spans[b][1], self.templates[t].name, dice) for a, b, t, dice in kept]


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each document: its best licence, or null, and all matches in text order."""

    def make():
        scan = Scanner()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            found = [scan(t) for t in texts_of(batch)]
            best = [max(f, key=lambda m: (m[3], -m[0]), default=None) for f in found]
            return {
                "doc_id": batch.column("doc_id"),
                "license": [b and b[2] for b in best],
                "dice": [b and b[3] for b in best],
                "n_matches": list(map(len, found)),
                "licenses": [[m[2] for m in f] for f in found],
                "dices": [[m[3] for m in f] for f in found],
                "starts": [[m[0] for m in f] for f in found],
                "ends": [[m[1] for m in f] for f in found],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
