"""SentencePiece (BPE) encoding and decoding by backtracking.

A text is cut before every run of spaces (no piece of the model has a space after another character, which is checked), and each
cut is encoded by itself: an Aho-Corasick automaton over the pieces gives, at every place, the longest piece that starts there
and, for every piece, the next shorter one that starts it. The encoder takes the longest piece that is compatible with the one
before it; two neighbours are compatible if merging their joined text again, by the model's merge order, gives these
two. Where no piece fits, it goes back one piece and marks the place in a bitfield, so no place fails twice. A sequence whose
neighbours are all compatible is the one that the merge procedure gives, so the result is exact. Characters without a piece
are coded by their bytes, and nothing merges across them.

Memory: each worker keeps the model, and the cuts it has encoded lately in two generations of at most ``CACHE`` entries, or as many as ``cache`` says. Cuts over
``LONG`` characters are not kept. Spark gives the worker with all it keeps to the next stage that runs Python, so stages that share an executor's memory keep less.

Defined results: a null text is encoded as an empty one (no ids, decoded text ""); equal texts are encoded alike; other columns play no part.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

SPACE = "▁"
CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE, LONG = 200_000, 64


class Encoder:
    """The pieces of one model, and how they merge."""

    def __init__(self, model: bytes, cache: int = CACHE):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without normalisation, with a dummy prefix, is needed")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = proto.pieces
        if any(p.type not in (1, 2, 3, 6) for p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == 2)
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(pieces) if p.type == 1}
        self.score = {p.piece: -p.score for p in pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space inside")
        self.text = [p.piece for p in pieces]
        self.chars = {p: i for p, i in self.id.items() if len(p) == 1}
        # Pieces that merging itself gives; no other can stand in a result.
        whole = {p: i for p, i in self.id.items() if len(p) == 1 or self._merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in whole.items():
            if len(p) > 1:  # each single character is its own shortest match anyway
                self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.text]
        self.shorter = [-1] * len(self.text)
        for p, i in whole.items():
            self.shorter[i] = next((whole[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), -1)
        self.digits = [str(i).encode() for i in range(len(self.text))]
        self.cache = cache
        self.fits: dict[int, bool] = {}
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _merged(self, text: str) -> list[str]:
        """The merge procedure, for a short text."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [(self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        known = self.fits.get(a << 20 | b)
        if known is None:
            if len(self.fits) >= 4 * self.cache:
                self.fits.clear()
            known = self.fits[a << 20 | b] = self._stands(self.text[a], self.text[b])
        return known

    def _stands(self, x: str, y: str) -> bool:
        """Whether merging x + y again ends with the edge between them still there. Only the pairs beside a merge are asked for anew."""
        rank, never = self.score.get, float("inf")
        parts, edge = list(x + y), len(x) - 1
        ranks = [rank(p + q, never) for p, q in zip(parts, parts[1:], strict=False)]
        while (best := min(ranks)) != never:
            i = ranks.index(best)
            if i == edge:
                return False
            edge -= i < edge
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return True

    def _known(self, text: str) -> list[int]:
        """The ids of a text of which every character has a piece; KeyError if one has none."""
        # At each end the matches come from the longest on, and ends come in order, so the last one for a start is its longest.
        longest = {end - k: i for end, (i, k) in self.automaton.iter(text)}
        chars, shorter, length, fits, get = self.chars, self.shorter, self.length, self.fits.get, longest.get
        last = get(0)
        if last is None:
            last = chars[text[0]]
        out, at, n = [last], length[last], len(text)
        while at < n:
            piece = get(at)
            if piece is None:
                piece = chars[text[at]]
            while not fits(last << 20 | piece) and not self._compatible(last, piece):
                piece = shorter[piece]
                if piece < 0:
                    return self._searched(text, longest)
            out.append(piece)
            last = piece
            at += length[piece]
        return out

    def _searched(self, text: str, longest: dict[int, int]) -> list[int]:
        """The same where the way forward has met a dead end: going back, with a bitfield of the places from which no sequence goes on to the end."""
        chars, shorter, length, fits = self.chars, self.shorter, self.length, self.fits.get
        n = len(text)
        out: list[int] = []
        failed = bytearray((n >> 3) + 1)
        at, last = 0, -1
        piece = longest[0] if 0 in longest else chars[text[0]]
        while True:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or fits(last << 20 | piece) or self._compatible(last, piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == n:
                    return out
                at, last = end, piece
                piece = longest[at] if at in longest else chars[text[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # an encoding exists, so there is one
                at -= length[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]

    def _cut(self, text: str) -> list[int]:
        try:
            return self._known(text)
        except KeyError:  # a character without a piece
            pass
        chars, ids = self.chars, []
        start = 0
        for i, c in enumerate(text):
            if c not in chars:
                if i > start:
                    ids += self._known(text[start:i])
                ids += [self.bytes[x] for x in c.encode()] if self.bytes else [self.unknown]
                start = i + 1
        if start < len(text):
            ids += self._known(text[start:])
        return ids

    def _miss(self, word: str) -> tuple[bytes, bytes]:
        got = self.old.get(word)
        if got is None:
            ids, digits = self._cut(word), self.digits
            got = (b",".join([digits[i] for i in ids]), array("i", ids).tobytes())
        if len(word) <= LONG:
            if len(self.young) >= self.cache:  # what was used since the last time stays
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def cuts(self, text: str | None) -> list[tuple[bytes, bytes]]:
        """For each cut of a text: its ids joined by commas, and its ids as bytes."""
        if not text:
            return []
        miss = self._miss
        return [self.young.get(w) or miss(w) for w in CUT.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return self.ids(self.cuts(text))

    @staticmethod
    def ids(cuts: list[tuple[bytes, bytes]]) -> list[int]:
        return array("i", b"".join([raw for _, raw in cuts])).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


_ENCODERS: dict[tuple[bytes, int], Encoder] = {}


def encoder(model: bytes, cache: int = CACHE) -> Encoder:
    """The encoder of a model, one in each process."""
    key = hashlib.sha256(model).digest(), cache
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, cache)
    return _ENCODERS[key]


def read_model(path: str) -> bytes:
    """A model file, read on the driver; it goes to the executors with the tasks' broadcast (some hundred KB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_as: str = "ids") -> DataFrame:
    """``df`` with the ids of every text, an array of ints."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("array<int>")
    def spm_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(shared.value)
        for texts in batches:
            yield pd.Series([np.array(e.encode(t if isinstance(t, str) else ""), np.int32) for t in texts])

    return df.withColumn(ids_as, spm_encode(F.col(text_col)))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_as: str = "decoded") -> DataFrame:
    """``df`` with the text of every array of ids; null counts as no ids."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def spm_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(shared.value)
        for rows in batches:
            yield pd.Series([e.decode([int(i) for i in x]) if x is not None and len(x) else "" for x in rows], dtype=object)

    return df.withColumn(text_as, spm_decode(F.col(ids_col)))


def _digested(e: Encoder, batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The digests of batches of texts. Python's collector rests meanwhile: nothing here makes cycles, and the caches are large."""
    collects = gc.isenabled()
    gc.disable()
    try:
        for texts in batches:
            n, ids_sha, text_sha = [], [], []
            for t in texts:
                parts = e.cuts(t if isinstance(t, str) else "")
                ids = e.ids(parts)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join([p[0] for p in parts])).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})
    finally:
        if collects:  # the worker goes on to other stages
            gc.enable()


def digests(df: DataFrame, model_path: str, text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256: both ways in one pass, without an array column on the way."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def spm_digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _digested(encoder(shared.value, cache), batches)

    own = fresh(df, "spm")
    kept = [c for c in df.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return df.withColumn(own, spm_digests(F.col(text_col))).select(*kept, f"{own}.*")
