"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy symbol arrays.

A round finds the best pair of every stretch at once, merges all its places from the left, and drops the stretches
that are done, until no pair remains. Tables come from the model file; results equal the library's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
_NONE = np.uint32(0xFFFFFFFF)
_FAR = np.int32(2**31 - 1)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PairTable:
    """Pairs of symbols to numbers: open addressing in two numpy arrays, looked up for many pairs at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, _NONE, dtype=np.uint32)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes = 0
        for key, value in zip(keys.tolist(), values.tolist(), strict=True):
            at, tried = ((key * 2654435761) & 0xFFFFFFFF) >> (32 - self.bits), 1
            while self.keys[at] != _NONE:
                at, tried = (at + 1) & ((1 << self.bits) - 1), tried + 1
            self.keys[at], self.values[at] = key, value
            self.probes = max(self.probes, tried)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where there is none or a symbol is negative."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = ((key * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], -1)
        todo = np.flatnonzero((got != key) & (got != _NONE))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got != _NONE)]
        out[(left < 0) | (right < 0)] = -1
        return out


@dataclass
class PieceModel:
    """Tables of a BPE model with byte fallback, the identity normaliser and a space put before the text."""

    pieces: list[str]
    rank: np.ndarray  # of a merge that makes the piece: smaller merges first
    alone: np.ndarray  # by rank: a new piece could next take part in a better merge, or the rank is shared
    chars: np.ndarray  # piece of each code point, -1 for none
    byte_first: int
    merges: PairTable
    inside: PairTable  # neighbouring characters that occur inside some piece

    @staticmethod
    def load(path: str) -> PieceModel:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(count)]
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        scores = np.array([model.get_score(i) for i in range(count)])
        levels, rank = np.unique(-scores, return_inverse=True)
        shared = np.bincount(rank[sorted(plain.values())], minlength=len(levels)) > 1
        alone, keys, values, inside = shared.copy(), [], [], set()
        for piece, i in plain.items():
            inside.update((plain.get(a, -1), plain.get(b, -1)) for a, b in zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                left, right = plain.get(piece[:k]), plain.get(piece[k:])
                if left is None or right is None:
                    continue
                keys.append(left << 16 | right)
                values.append(i)
                for part, text in ((left, piece[:k]), (right, piece[k:])):
                    if len(text) > 1 and rank[part] > rank[i]:
                        alone[rank[part]] = True
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece has a space after other characters, so texts cannot be split at spaces")
        if any(a < 0 or b < 0 for a, b in inside):
            raise ValueError("a piece has a character that is no piece itself")
        chars = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in plain.items():
            if len(piece) == 1:
                chars[ord(piece)] = i
        byte_first = next(i for i in range(count) if model.is_byte(i))
        pairs = np.array(sorted(a << 16 | b for a, b in inside), dtype=np.uint32)
        return PieceModel(pieces, rank.astype(np.int32), alone, chars, byte_first, PairTable(np.array(keys, dtype=np.uint32), np.array(values)), PairTable(pairs, np.ones(len(pairs))))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word begins in them."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        begins = np.concatenate(([0], np.cumsum(lengths)))
        if n == 0:
            return np.zeros(0, np.int64), begins
        symbol = self.chars[points]
        # a stretch ends with its word, and between characters that stand side by side in no piece
        edge = np.ones(n, dtype=bool)
        edge[1:] = self.inside.get(symbol[:-1], symbol[1:]) < 0
        edge[begins[:-1][begins[:-1] < n]] = True
        stretch = np.cumsum(edge, dtype=np.int32)
        place = np.arange(n, dtype=np.int32)
        done_place, done_symbol = [], []

        into = np.full(n, -1, dtype=np.int32)  # the piece that the symbol and the next one make
        into[:-1] = np.where(stretch[:-1] == stretch[1:], self.merges.get(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = np.where(into >= 0, self.rank[into], _FAR)
            heads = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
            sizes = np.diff(np.concatenate((heads, [len(symbol)])))
            best = np.minimum.reduceat(rank, heads)
            over = best == _FAR
            if over.any():
                drop = np.repeat(over, sizes)
                done_place.append(place[drop])
                done_symbol.append(symbol[drop])
                keep = ~drop
                symbol, stretch, place, into, rank = symbol[keep], stretch[keep], place[keep], into[keep], rank[keep]
                best, sizes = best[~over], sizes[~over]
                if not len(symbol):
                    break
                heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            here = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = stretch[here]
            fresh = np.concatenate(([True], owner[1:] != owner[:-1]))
            # places that touch: every second of a run, from the left
            run = np.concatenate(([True], (here[1:] != here[:-1] + 1) | fresh[1:]))
            first = np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
            chosen = here[((np.arange(len(here)) - first) % 2 == 0) & (fresh | ~self.alone[rank[here]])]
            symbol[chosen] = into[chosen]
            stays = np.ones(len(symbol), dtype=bool)
            stays[chosen + 1] = False
            symbol, stretch, place, into = symbol[stays], stretch[stays], place[stays], into[stays]
            moved = chosen - np.arange(len(chosen))
            near = np.zeros(len(symbol), dtype=bool)
            near[moved] = near[moved[moved > 0] - 1] = True
            touched = np.flatnonzero(near)
            into[touched] = -1
            touched = touched[touched < len(symbol) - 1]
            touched = touched[stretch[touched] == stretch[touched + 1]]
            into[touched] = self.merges.get(symbol[touched], symbol[touched + 1])
        symbol, place = np.concatenate(done_symbol), np.concatenate(done_place)
        order = np.argsort(place)
        symbol, place = symbol[order].astype(np.int64), place[order]

        # characters outside the vocabulary become the pieces of their UTF-8 bytes
        lost = np.flatnonzero(symbol < 0)
        if len(lost):
            raw = [chr(c).encode("utf-8") for c in points[place[lost]].tolist()]
            repeat = np.ones(len(symbol), dtype=np.int64)
            repeat[lost] = [len(x) for x in raw]
            symbol, place = np.repeat(symbol, repeat), np.repeat(place, repeat)
            symbol[symbol < 0] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) + self.byte_first
        return symbol, np.searchsorted(place, begins)


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [begin, begin + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Strings:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings], dtype=np.int32)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes and where each string begins in them, with the total at the end."""
        lengths = self.lengths[numbers]
        return self.data[_ranges(self.begins[numbers], lengths)], np.concatenate(([0], np.cumsum(lengths)))


class Encoder:
    """Encodes whole texts. Words that have been met are kept until there are ``keep`` of them."""

    def __init__(self, model: PieceModel, keep: int = 300_000):
        self.model, self.keep = model, keep
        first = model.byte_first
        self.shown = _Strings([bytes([i - first]) if first <= i < first + 256 else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)])
        self.said = _Strings([b"%d," % i for i in range(len(model.pieces))])
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.begins, self.lengths = np.zeros((2, 1 << 14), dtype=np.int64)
        self.used = 0

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: list[str]) -> None:
        known = self.number
        new = list({w for w in words if w not in known})
        for first in range(0, len(new), 8192):  # arrays that fit the processor's cache
            part = new[first : first + 8192]
            ids, begins = self.model.encode(part)
            count, total = len(known), self.used + len(ids)
            if total > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(total, dtype=np.int32)))
            if count + len(part) > len(self.begins):
                more = np.zeros((2, count + len(part)), dtype=np.int64)
                self.begins, self.lengths = np.concatenate((self.begins, more[0])), np.concatenate((self.lengths, more[1]))
            self.ids[self.used : total] = ids
            self.begins[count : count + len(part)] = begins[:-1] + self.used
            self.lengths[count : count + len(part)] = np.diff(begins)
            known.update(zip(part, range(count, count + len(part)), strict=True))
            self.used = total

    def slices(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time: their ids in a row, and where each text begins in them, with the total."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= 1 << 19):
                size += len(texts[last])
                last += 1
            split = [self.words(t) for t in texts[first:last]]
            words = [w for x in split for w in x]
            if len(self.number) > self.keep:
                self._forget()
            self.learn(words)
            numbers = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
            lengths = self.lengths[numbers]
            counts = np.concatenate(([0], np.cumsum([len(x) for x in split])))
            yield self.ids[_ranges(self.begins[numbers], lengths)], np.concatenate(([0], np.cumsum(lengths)))[counts]
            first = last

    def rows(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
        """Of each text: ids, ids joined by commas, decoded text in UTF-8."""
        for ids, begins in self.slices(texts):
            said, said_at = self.said.join(ids)
            shown, shown_at = self.shown.join(ids)
            said, shown, said_at, shown_at = said.tobytes(), shown.tobytes(), said_at[begins].tolist(), shown_at[begins].tolist()
            marks = begins.tolist()
            for k in range(len(marks) - 1):
                # the space put before the text is taken off
                yield ids[marks[k] : marks[k + 1]], said[said_at[k] : max(said_at[k], said_at[k + 1] - 1)], shown[shown_at[k] + 1 : shown_at[k + 1]]


def encode(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Returns doc_id, n_tokens, ids (array) and decoded, or with ``digests`` doc_id, n_tokens and the SHA-256 of the
    ids joined by commas and of the decoded text. Null counts as empty: no ids and an empty text. Null ids and
    repeated rows are kept; texts of any length are encoded whole. No shuffle; the tables are read from the model
    once, on the driver, and travel with the tasks (their size is that of the vocabulary).
    """
    model = PieceModel.load(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = list(encoder.rows([t or "" for t in part.column(1).to_pylist()]))
                counts = pa.array([len(ids) for ids, _, _ in rows], pa.int64())
                if digests:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    rest = [pa.array([sha(x) for _, x, _ in rows], pa.string()), pa.array([sha(x) for _, _, x in rows], pa.string())]
                else:
                    rest = [pa.array([ids for ids, _, _ in rows], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for _, _, x in rows], pa.string())]
                names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
                yield pa.RecordBatch.from_arrays([part.column(0), counts, *rest], names)

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
