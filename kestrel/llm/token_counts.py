"""Token counts: a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is two sets of byte strings: pieces that may start a word and pieces that
go on with it. Both are tries of one automaton. A node without a matching child follows its
failure link to the node where greedy longest-match would go on; the number of pieces cut
off on that way is stored with the link, so counting needs no pieces and every byte is read
once (amortised). Distinct words are run together, one byte position at a time.

Words are maximal runs of bytes outside ASCII white space, of any length. Defined results:
null and empty texts have no words; a word that the pieces cannot cover counts as one
token and one unknown word; repeated rows are counted each; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"
# Memory bound of a worker's word cache, emptied when full: entries and bytes an entry, under 150 MB.
CACHE_WORDS, LONGEST_CACHED = 500_000, 128
LONGEST_BATCHED = 512      # longer words are counted one by one
UNKNOWN = 1 << 40          # a word's count plus this marks an unknown word


@dataclass
class Automaton:
    """Nodes 0 (word start) and 1 (inside a word) are the roots."""
    keys: np.ndarray      # node * 256 + byte of every trie edge, ascending
    targets: np.ndarray
    fail: np.ndarray      # failure link, -1: none
    pops: np.ndarray      # pieces cut off when it is followed
    at_end: np.ndarray    # pieces cut off when the word ends here, -1: it cannot end here

    @staticmethod
    def build(initial: Iterable[bytes], inner: Iterable[bytes]) -> Automaton:
        edges: list[dict[int, int]] = [{}, {}]
        is_piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = edges[node].get(byte)
                    if nxt is None:
                        nxt = edges[node][byte] = len(edges)
                        edges.append({})
                        is_piece.append(False)
                    node = nxt
                is_piece[node] = len(piece) > 0 or is_piece[node]
        n = len(edges)
        fail, pops = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at_end = np.full(n, -1, np.int64)
        at_end[1] = 0
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, child in edges[node].items():
                queue.append(child)
                if is_piece[child]:
                    fail[child], pops[child] = 1, 1
                else:
                    link, cut = fail[node], pops[node]
                    while link >= 0 and byte not in edges[link]:
                        cut += pops[link]
                        link = fail[link]
                    if link >= 0:
                        fail[child], pops[child] = edges[link][byte], cut
                if fail[child] >= 0 and at_end[fail[child]] >= 0:
                    at_end[child] = pops[child] + at_end[fail[child]]
        pairs = sorted((node * 256 + byte, child) for node, out in enumerate(edges) for byte, child in out.items())
        keys, targets = np.array(pairs, np.int64).reshape(-1, 2).T
        return Automaton(np.append(keys, np.int64(1) << 62), np.append(targets, -1), fail, pops, at_end)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state * 256 + byte
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of every (non-empty) word; ``UNKNOWN + 1`` for an unknown word."""
        if any(len(w) > LONGEST_BATCHED for w in words):
            short = iter(self.count([w for w in words if len(w) <= LONGEST_BATCHED]).tolist())
            return np.array([next(short) if len(w) <= LONGEST_BATCHED else self.count_one(w) for w in words], np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        text = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(length) - length)[order]
        length = length[order]
        state, count, dead = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        alive = len(words)
        for i in range(int(length[0]) if len(words) else 0):
            while length[alive - 1] <= i:   # longest first: the active words are a prefix
                alive -= 1
            byte = text[start[:alive] + i].astype(np.int64)
            nxt = self._step(state[:alive], byte)
            miss = np.flatnonzero(nxt < 0)
            while len(miss):
                link = self.fail[state[miss]]
                count[miss] += self.pops[state[miss]]
                lost = link < 0
                dead[miss[lost]] = True
                nxt[miss[lost]] = 0
                miss, link = miss[~lost], link[~lost]
                state[miss] = link
                to = self._step(link, byte[miss])
                nxt[miss] = to
                miss = miss[to < 0]
            state[:alive] = nxt
        end = self.at_end[state]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(dead | (end < 0), UNKNOWN + 1, count + end)
        return out


    def count_one(self, word: bytes) -> int:
        """``count`` of one word by plain steps: a long word has no company in a batch."""
        table, fail, pops = self._plain()
        state = count = 0
        for byte in word:
            nxt = table.get(state << 8 | byte, -1)
            while nxt < 0:
                count += pops[state]
                state = fail[state]
                if state < 0:
                    return UNKNOWN + 1
                nxt = table.get(state << 8 | byte, -1)
            state = nxt
        end = int(self.at_end[state])
        return UNKNOWN + 1 if end < 0 else count + end

    def _plain(self) -> tuple[dict[int, int], list[int], list[int]]:
        if not hasattr(self, "_tables"):
            self._tables = (dict(zip(self.keys.tolist(), self.targets.tolist())), self.fail.tolist(), self.pops.tolist())
        return self._tables


def byte_level_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(initial, inner) pieces of a byte-level vocabulary file, whose word-start pieces begin with a blank."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pieces = [bytes(byte_of[c] for c in p) for p in spec["model"]["vocab"] if p not in special]
    plain = [p for p in pieces if p and not p.strip(b" ").split()[1:] and p.split() == [p.strip(b" ")]]
    return ([p[1:] for p in plain if p[:1] == b" " and p[1:2] != b" "], [p for p in plain if p[:1] != b" "])


def token_counts(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row."""
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column("text").to_pylist()]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                new = list(set().union(*words).difference(cache))
                cache.update(zip(new, held.value.count(new).tolist()))
                total = [sum(map(cache.__getitem__, w)) for w in words]
                for w in new:
                    if len(w) > LONGEST_CACHED:
                        del cache[w]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([t % UNKNOWN for t in total], pa.int64()),
                     pa.array([t // UNKNOWN for t in total], pa.int64())],
                    ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    automaton = Automaton.build(*byte_level_vocabulary(public_tokenizers.path(VOCABULARY)))
    return token_counts(documents(spark, sf_dir), automaton)
