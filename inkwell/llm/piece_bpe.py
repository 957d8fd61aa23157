"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across (before a space mark, around a line feed), the distinct
cuts are encoded together, and each text's ids are gathered from them. One round finds the best pair of every cut with a
segmented minimum over one flat symbol array, merges its occurrences from the left at once, and compacts the array. A piece
that could at once be part of a pair as good or better ends the round for its word, so that the outcome is what one merge
at a time gives.

Null and empty texts have no ids and decode to the empty text. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import slices, spread, table

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Distinct cuts that a worker remembers before it starts anew.
MEMORY = 300_000


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if not all(sp.is_byte(int(i)) for i in self.byte_ids) or sp.encode("A  B ", out_type=str)[0][0] != MARK:
            raise ValueError("a model with byte fallback and a dummy prefix is needed")
        scores = np.array([sp.get_score(i) for i in range(size)])
        order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores share a rank
        self.order = order
        self.size = size
        left, right, to = [], [], []
        unsafe = np.zeros(size, bool)
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(i)
                    for part in (a, b):
                        unsafe[part] |= order[i] <= order[part]
        self.unsafe = unsafe
        self._build_pairs(np.array(left, np.int64), np.array(right, np.int64), np.array(to, np.int32))
        chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.char_ids = np.full(0x110000, -1, np.int32)
        self.char_ids[[ord(c) for c in chars]] = list(chars.values())
        inner = {c for p in self.ids for c in p}
        lone = all(MARK not in p.lstrip(MARK) and (len(p) - len(p.lstrip(MARK)) < 2 or not p.lstrip(MARK)) for p in self.ids)
        if not lone:
            raise ValueError("pieces with inner spaces aren't supported")
        run = self._long_run()
        self.cuts = re.compile((f"{MARK}{{{run}}}(?={MARK})|" if run else "") + (f"{MARK}*[^{MARK}]+|{MARK}+" if "\n" in inner else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"))
        surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        self.surface = surface
        self.surface_data = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(x) for x in surface])
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.is_byte = np.isin(np.arange(size), self.byte_ids)
        self.is_control = np.array([sp.is_control(i) for i in range(size)])
        self.decimal = [str(i) for i in range(size)]

    def _build_pairs(self, left: np.ndarray, right: np.ndarray, to: np.ndarray) -> None:
        """An open hash table from pairs of ids to the id of their merged piece."""
        self.mask = (1 << int(4 * len(to) + 15).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.zeros(self.mask + 1, np.int32)
        key, at = left * self.size + right, self._slot(left, right)
        self.probes = 0
        while len(key):
            self.probes += 1
            free = self.keys[at] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            won = free & first
            self.keys[at[won]], self.values[at[won]] = key[won], to[won]
            key, to, at = key[~won], to[~won], (at[~won] + 1) & self.mask

    def _long_run(self) -> int:
        """The longest run of space marks that is a piece, if a longer run always begins with it; else 0."""
        run = max(len(p) for p in self.ids if not p.strip(MARK))
        cuts = [MARK * n for n in range(1, 3 * run)]
        ids, size = self.encode_cuts(cuts)
        found = np.split(ids, np.cumsum(size)[:-1])
        return run if all(found[n - 1].tolist() == [self.ids[MARK * run], *found[n - run - 1].tolist()] for n in range(run + 1, 3 * run)) else 0

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 5) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs make, -1 where they make none."""
        known = (left < self.size) & (right < self.size)
        key = left.astype(np.int64) * self.size + right
        at = self._slot(left.astype(np.int64), right.astype(np.int64))
        out = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(known)
        for _ in range(self.probes):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts one after another, and how many each has."""
        if not cuts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(cuts)), [len(x) for x in cuts])
        symbol = self.char_ids[codes]
        symbol = np.where(symbol < 0, self.size + codes, symbol).astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = self._pairs(symbol, word)
        while len(symbol):
            rank = np.where(pair >= 0, self.order[pair], NONE)
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, begins)
            of = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            ended = best[of] == NONE
            if ended.any():
                done.append((word[ended], symbol[ended]))
                go = ~ended
                symbol, word, pair, rank, of = symbol[go], word[go], pair[go], rank[go], of[go]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best[of])
            # overlapping places: every second of a run of neighbours, from its left
            new = np.r_[True, np.diff(at) != 1]
            lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            at = at[(at - lead) % 2 == 0]
            odd = self.unsafe[pair[at]]
            if odd.any():  # a word merges nothing right of its leftmost careful place
                before = np.cumsum(odd) - odd
                first = np.r_[True, of[at[1:]] != of[at[:-1]]]
                at = at[before == before[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]
            symbol[at] = pair[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            symbol, word, pair = symbol[keep], word[keep], pair[keep]
            fresh = np.concatenate([moved, moved[moved > 0] - 1])
            pair[fresh] = -1
            fresh = fresh[fresh + 1 < len(symbol)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            pair[fresh] = self.merged(symbol[fresh], symbol[fresh + 1])
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return self._bytes(word[order], symbol[order], len(cuts))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = np.full(len(symbol), -1, np.int32)
        at = np.flatnonzero(word[1:] == word[:-1])
        pair[at] = self.merged(symbol[at], symbol[at + 1])
        return pair

    def _bytes(self, word: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that no piece holds become their UTF-8 bytes."""
        odd = np.flatnonzero(symbol >= self.size)
        if len(odd):
            raw = [chr(c).encode() for c in symbol[odd] - self.size]
            width = np.ones(len(symbol), np.int64)
            width[odd] = [len(x) for x in raw]
            at = np.repeat(np.cumsum(width)[odd] - width[odd], width[odd]) + spread(width[odd])[1]
            symbol, word = np.repeat(symbol, width), np.repeat(word, width)
            symbol[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return symbol, np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of runs of ids, laid out one after another and ending at ends."""
        width = self.surface_len[ids]
        group, place = spread(width)
        data = self.surface_data[self.surface_at[ids][group] + place].tobytes()
        stops = np.r_[0, np.cumsum(width)][ends]
        out, start, first = [], 0, 0
        for stop, end in zip(stops.tolist(), ends.tolist()):
            raw = data[start:stop]
            while first < end and self.is_control[ids[first]]:
                first += 1
            if first < end and self.pieces[ids[first]].startswith(MARK):  # the dummy prefix
                raw = raw[1:]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self._mended(ids[first:end])
            out.append(raw)
            start, first = stop, end
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """As decode() for one run of ids whose byte pieces aren't all UTF-8: each byte that fits nowhere becomes U+FFFD."""
        out: list[bytes] = []
        run = b""
        for k, i in enumerate([*ids.tolist(), -1]):
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if self._whole(run[:n])), 0)
                out.append(run[:size] if size else "�".encode())
                run = run[size or 1 :]
            if i >= 0:
                out.append(self.surface[i][1:] if not k and self.pieces[i].startswith(MARK) else self.surface[i])
        return b"".join(out)

    @staticmethod
    def _whole(raw: bytes) -> bool:
        try:
            return len(raw.decode()) == 1
        except UnicodeDecodeError:
            return False


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model at path, read once in a process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


class _Codes(dict):
    """Numbers cuts in order of their first sight."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """Encodes texts with a memory of the cuts seen before."""

    def __init__(self, path: str):
        self.model = model(path)
        self._reset()

    def _reset(self) -> None:
        self.codes, self.ids, self.len = _Codes(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        if len(self.codes) > MEMORY:
            self._reset()
        find, code = self.model.cuts.findall, self.codes.__getitem__
        seen: list[int] = []
        stops = []
        for text in texts:
            if text:
                seen.extend(map(code, find(MARK + text.replace(" ", MARK))))
            stops.append(len(seen))
        ids, size = self.model.encode_cuts(self.codes.fresh)
        self.codes.fresh.clear()
        self.ids, self.len = np.concatenate([self.ids, ids]), np.concatenate([self.len, size])
        at = np.cumsum(self.len) - self.len
        seen = np.array(seen, np.int64)
        group, place = spread(self.len[seen])
        return self.ids[at[seen][group] + place], np.r_[0, np.cumsum(self.len[seen])][stops]


def encode_and_decode(docs: DataFrame, path: str, digests: bool = True) -> DataFrame:
    """doc_id with the ids of its text and the text decoded from them; with digests, their counts and hashes instead."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, "text"):
            ids, ends = encoder.encode(batch.column(1).to_pylist())
            texts = encoder.model.decode(ids, ends)
            starts = np.r_[0, ends[:-1]]
            if digests:
                decimal = encoder.model.decimal.__getitem__
                columns = [
                    pa.array(ends - starts, pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(starts, ends)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                ]
            else:
                columns = [pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1:]], pa.int32()), pa.array(ids, pa.int32())), pa.array([x.decode() for x in texts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), default_model())
