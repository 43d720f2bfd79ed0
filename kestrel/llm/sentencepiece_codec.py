"""SentencePiece encoding and decoding: shared-prefix Viterbi.

Blanks become the marker U+2581, one is put in front, and the text falls into marked words
(markers, then other characters); no piece of the vocabulary crosses such a boundary. The
distinct words of a batch, sorted, are a trie in depth-first order: a word keeps the forward
scores of the prefix it shares with the one before it and computes only the rest. The best
segmentation maximises the sum of the pieces' scores; of equal sums at a position the
longest last piece wins. A character without a piece costs ``lowest score - 10`` and is
written as its UTF-8 bytes. Decoding joins the pieces and bytes and drops the first blank.

Defined results: null and empty texts have no ids and decode to the empty text; a literal
marker in a text decodes to a blank; repeated rows are encoded each; an empty table gives
an empty result; extra columns are kept, ``ids`` and ``n_tokens`` replace columns of these names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import documents

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0     # fixed value of the SentencePiece library
LONGEST_CACHED = 64        # code points; with CACHE_WORDS a bound in bytes, under 200 MB
CACHE_WORDS = 300_000      # a worker keeps the words of its last one to two times so many new ones

def _id(i: int) -> bytes:
    return array("i", [i]).tobytes()


# Runs of Latin letters and runs of other characters, each with the markers before it.
_PARTS = re.compile(rf"{MARK}*(?:[A-Za-zÀ-ÖØ-öø-ʯ]+|[^{MARK}A-Za-zÀ-ÖØ-öø-ʯ]+)|{MARK}+")


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[float, bytes] | None]   # score and id of a piece; None for what only ends one
    byte_ids: list[bytes]             # ids as 32-bit integers in bytes, like those of the pieces
    surfaces: list[bytes]             # what an id decodes to
    unknown: float
    cut: bool                         # no piece joins a Latin letter and another character: words fall apart there

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size)
                 if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        surfaces = [b""] * size
        byte_ids = [b""] * 256
        for i in range(size):
            if sp.is_byte(i):
                byte = int(names[i][3:5], 16)
                byte_ids[byte], surfaces[i] = _id(i), bytes([byte])
        pieces: dict[str, tuple[float, bytes] | None] = {}
        for i in plain:
            if MARK in names[i].lstrip(MARK):
                raise ValueError(f"piece {names[i]!r} crosses a word boundary")
            surfaces[i] = names[i].replace(MARK, " ").encode()
            for k in range(1, len(names[i])):
                pieces.setdefault(names[i][k:], None)
        pieces.update((names[i], (sp.get_score(i), _id(i))) for i in plain)
        lowest = min(sp.get_score(i) for i in plain)
        cut = all(len(_PARTS.findall(names[i])) == 1 for i in plain)
        return Vocabulary(pieces, byte_ids, surfaces, lowest - UNKNOWN_PENALTY, cut)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of every distinct word, by its parts where no piece can cross between them."""
        if not self.cut:
            return self._viterbi(words)
        parts = {w: _PARTS.findall(w) for w in words}
        ids = self._viterbi(set().union(*parts.values()))
        return {w: ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for w, p in parts.items()}

    def _viterbi(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of every distinct word; what holds for a shared prefix is computed once."""
        out: dict[str, bytes] = {}
        # By end position: forward score, start and ids of the last piece of the best segmentation.
        best, back, tail = [0.0], [0], [b""]
        find, last = self.pieces.get, ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], back[shared + 1:], tail[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                start = at = end - 1
                hit = find(word[start], False)
                piece = hit or (self.unknown, b"".join([self.byte_ids[b] for b in word[start].encode("utf-8", "surrogatepass")]))
                top = best[start] + piece[0]
                while start and hit is not False:
                    start -= 1
                    hit = find(word[start:end], False)
                    if hit and best[start] + hit[0] >= top:
                        top, at, piece = best[start] + hit[0], start, hit
                best.append(top)
                back.append(at)
                tail.append(piece[1])
            end, ids = len(word), []
            while end:
                ids.append(tail[end])
                end = back[end]
            out[word] = b"".join(ids[::-1])
            last = word
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join(self.encode_words([w])[w] for w in marked_words(text))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")[1:]


def marked_words(text: str) -> list[str]:
    words, marks = [], MARK
    for part in text.replace(MARK, " ").split(" "):
        if part:
            words.append(marks + part)
            marks = MARK
        else:
            marks += MARK
    # Each blank that ends the text left one marker too many for the word that never came.
    if len(marks) > 1:
        words.append(marks[1:])
    return words if text else []


class _Encoder:
    """Encodes blocks of texts in a Python worker; keeps the words of one to two generations."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        docs = [marked_words(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words, self.before = {}, self.words
        words, before = self.words, self.before
        new = set().union(*docs).difference(words)
        old = new.intersection(before)
        words.update((w, before[w]) for w in old)
        words.update(self.vocabulary.encode_words(new - old))
        out = [b"".join(map(words.__getitem__, d)) for d in docs]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del words[w]
        return out


def _blocks(text: pa.Array) -> Iterator[list[str]]:
    for at in range(0, len(text), 512):
        yield [t or "" for t in text[at:at + 512].to_pylist()]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encoder(spark: SparkSession, vocabulary: Vocabulary):
    """Column function: text -> array<int> of ids."""
    held = spark.sparkContext.broadcast(vocabulary)
    state: list[_Encoder] = []

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        if not state:
            state.append(_Encoder(held.value))
        return _lists([ids for block in _blocks(text) for ids in state[0].encode(block)])
    return encode


def checked_encoder(spark: SparkSession, vocabulary: Vocabulary):
    """Column function: text -> struct(ids, round_trip), round_trip: the ids decode to the text."""
    held = spark.sparkContext.broadcast(vocabulary)
    state: list[_Encoder] = []

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def encode(text: pa.Array) -> pa.Array:
        if not state:
            state.append(_Encoder(held.value))
        out, same = [], []
        for block in _blocks(text):
            ids = state[0].encode(block)
            out += ids
            same += [held.value.decode(np.frombuffer(x, np.int32).tolist()) == t.replace(MARK, " ")
                     for x, t in zip(ids, block)]
        return pa.StructArray.from_arrays([_lists(out), pa.array(same, pa.bool_())], ["ids", "round_trip"])
    return encode


def decoder(spark: SparkSession, vocabulary: Vocabulary):
    """Column function: array<int> of ids -> text (null ids: empty)."""
    held = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False)
        return pa.array([held.value.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])],
                        pa.string())
    return decode


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` plus ids and n_tokens."""
    out = docs.withColumn("ids", encoder(docs.sparkSession, vocabulary)(F.col("text").cast("string")))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


def encode_checked(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding the ids gives the text back."""
    coded = checked_encoder(docs.sparkSession, vocabulary)(F.col("text").cast("string"))
    out = docs.select("doc_id", coded.alias("c"))
    return out.select("doc_id", "c.ids", F.size("c.ids").cast("long").alias("n_tokens"), "c.round_trip")


def production_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(MODEL))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(documents(spark, sf_dir), production_vocabulary())
