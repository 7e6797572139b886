"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link at each node: the node where matching goes on
after the longest pieces of the node's string have been popped, with the number
of pieces popped on the way. A word is read once, byte by byte; where the trie has no edge, the
failure link is taken and its count added. No piece is ever built. Words repeat, so each
worker remembers the counts of words it has met.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.hashing import slices

REMEMBERED = 500_000  # words whose counts a worker keeps
_automata: dict[str, Automaton] = {}


class Automaton:
    """``first``: pieces that can start a word; ``rest``: pieces that can follow. All are bytes, none empty."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]) -> None:
        self.edges: list[dict[int, int]] = [{}, {}]  # nodes 0 and 1: start of a word, start of a later piece
        whole = [False, False]
        for root, pieces in enumerate((first, rest)):
            for piece in pieces:
                node = root
                for b in piece:
                    if b not in self.edges[node]:
                        self.edges[node][b] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    node = self.edges[node][b]
                whole[node] = True
        self.link, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for b, node in self.edges[parent].items():
                if whole[node]:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    z, pops = self.link[parent], self.popped[parent]
                    while z >= 0 and b not in self.edges[z]:
                        pops += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[node], self.popped[node] = self.edges[z][b], pops
                queue.append(node)
        self.known: dict[bytes, int] = {}

    @classmethod
    def from_byte_bpe(cls, path: str) -> Automaton:
        """Pieces of a byte-level vocabulary file: those with a leading space start words (the space is a word's first byte)."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"] for x in model.get("added_tokens", ())}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        pieces = [bytes(shown[c] for c in token) for token in model["model"]["vocab"] if token not in special]
        return cls([p for p in pieces if p[:1] == b" "], [p for p in pieces if b" " not in p])

    def pieces_in(self, word: bytes) -> int:
        """Number of pieces of a word by greedy longest match; 1 (the unknown piece) if it cannot be matched."""
        edges, link, popped, node, n = self.edges, self.link, self.popped, 0, 0
        for b in word:
            while b not in edges[node]:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = edges[node][b]
        while node != 1:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1 if word else 0
        return n

    def count(self, text: bytes) -> tuple[int, int]:
        """(words, pieces) of a whole text; words are parted by ASCII white space."""
        words = text.split()
        try:
            return len(words), sum(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
        total = 0
        for word in words:
            n = self.known.get(word)
            if n is None:
                n = self.pieces_in(b" " + word)
                if len(word) <= 64:
                    self.known[word] = n
            total += n
        return len(words), total


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton.from_byte_bpe(path)
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of ``docs`` (doc_id, text; other columns are left out).

    A null, empty or blank text has 0 of both. Repeated rows and null ids are kept as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        for batch in slices(batches):
            found = [machine.count((text or "").encode("utf-8", "surrogatepass")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
