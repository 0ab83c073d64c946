"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie with two roots, for pieces that begin a word and for those that go on within one. Where a
word leaves the trie, a node's failure link tells where its unmatched rest stands after the longest pieces before
it are taken, and a precomputed number how many pieces those are: a word's greedy longest-match pieces are counted in one
pass over its characters, and never built.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.llm import pieces
from marktlens.llm.common import map_rows, small_batches

#: Blank-separated strings that a task remembers; when full they are forgotten and counted anew.
MEMO = 500_000
_WORD = re.compile(r"\w+|[^\w\s]")


class Automaton:
    def __init__(self, first: set[str], further: set[str]):
        """first: pieces at the start of a word; further: those inside one."""
        self.next: list[dict[str, int]] = [{}, {}]  # roots: 0 for the start, 1 for the rest of a word
        ends = set()
        for root, vocabulary in ((0, first), (1, further)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next.append({})
                        self.next[node][c] = len(self.next) - 1
                    node = self.next[node][c]
                if piece:
                    ends.add(node)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if child in ends:  # the whole path is a piece
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    at, taken = self.fail[node], self.popped[node]
                    while at >= 0 and c not in self.next[at]:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][c], taken
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if its greedy match gets stuck."""
        node = taken = 0
        for c in word:
            while (to := self.next[node].get(c, -1)) < 0:
                if self.fail[node] < 0:
                    return 0
                taken += self.popped[node]
                node = self.fail[node]
            node = to
        while node != 1:
            if self.fail[node] < 0:
                return 0
            taken += self.popped[node]
            node = self.fail[node]
        return taken


def vocabulary(model: bytes) -> tuple[set[str], set[str]]:
    """Start and inner pieces of a SentencePiece model: those with the marker in front begin words."""
    first, further = set(), set()
    for p, _, kind in pieces.parse(model)["pieces"]:
        if kind in (pieces.NORMAL, pieces.USER):
            if p.startswith(pieces.MARK):
                first.add(p[1:])
            else:
                further.add(p)
    return {p for p in first if p and pieces.MARK not in p}, {p for p in further if pieces.MARK not in p}


class _Counts(dict):
    """Words, pieces and unknown words of blank-separated strings; a missing one is counted and remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: str) -> tuple[int, int, int]:
        each = [self.automaton.count(w) for w in _WORD.findall(chunk)]
        if len(self) >= MEMO:
            self.clear()
        found = self[chunk] = len(each), sum(max(1, n) for n in each), each.count(0)
        return found


@lru_cache(maxsize=2)
def _counts(model: bytes) -> _Counts:
    return _Counts(Automaton(*vocabulary(model)))


def count_tokens(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """The rows of `docs` with n_words, n_tokens and n_unknown (long). Words are runs of word characters, other characters
    words of their own; a word that the vocabulary can't spell counts as one token. Null and empty texts have none;
    columns with the new names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(pieces.load(spark, path))
    new = ("n_words", "n_tokens", "n_unknown")
    rest = [c for c in docs.columns if c not in new and c != column]
    fields = [f for f in docs.schema if f.name in rest]
    keep = [f for f in docs.schema if f.name == column]

    def work(batches):
        counts = _counts(shipped.value)
        for b in batches:
            sums = [tuple(map(sum, zip(*map(counts.__getitem__, (t or "").split())))) or (0, 0, 0) for t in b.column(column).to_pylist()]
            yield {f.name: b.column(f.name) for f in [*fields, *keep]} | {c: [s[i] for s in sums] for i, c in enumerate(new)}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in [*fields, *keep]), *(f"{c} long" for c in new)])
    return map_rows(docs.select(*rest, F.col(column)), work, schema)
