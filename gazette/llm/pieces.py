"""Exact encoding with a merge-type SentencePiece model by backtracking, and decoding.

A text is cut where no piece of the vocabulary crosses: before a run of word marks
and around line feeds. Within a chunk an Aho-Corasick automaton gives the longest
piece that begins at each character. The encoder takes it, and accepts it behind
the piece before only if merging the two pieces' characters afresh yields these two
pieces again (the result is remembered). Otherwise it tries the next shorter piece;
if none is left, the position is marked in a bitfield of failed positions and the
encoder steps back by one piece. Chunks in which pieces of equal score compete (runs
of word marks) are merged outright, as ties are settled by place there.

Defined cases. Null or empty text: no ids, empty decoded text. Null doc_id and
repeated rows: rows like any other. Characters outside the vocabulary: byte pieces. A word
mark U+2581 in a text is a space after decoding, as in the library. Empty table:
empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import held, tidy
from gazette.staging import small_batches

MARK = "▁"
#: Chunks and pairs that one worker remembers at most, and the longest chunk it remembers.
REMEMBERED, LONGEST = 200_000, 40


class PieceModel:
    """A BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  b "
        if lib.decode(lib.encode(probe)) != probe or lib.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this encoder needs a model with an identity normaliser and a dummy prefix")
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [-1] * 256
        self.raw: list[bytes | None] = []  # what an id stands for
        self.is_byte = [lib.is_byte(i) for i in range(lib.vocab_size())]
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if self.is_byte[i]:
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            elif lib.is_control(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        if min(self.byte_id) < 0:
            raise ValueError("this encoder needs byte pieces")
        for piece in self.ids:
            if len(piece) > 1 and ("\n" in piece or MARK in piece.lstrip(MARK)):
                raise ValueError(f"piece {piece!r} crosses the places where texts are cut")
            if not all(c in self.ids for c in piece):
                raise ValueError(f"a character of piece {piece!r} is no piece itself")
        self.piece = {i: p for p, i in self.ids.items()}
        self.chars = {c for c in self.ids if len(c) == 1}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.raw)  # the longest piece that is a shorter prefix
        self.size = [len(self.piece.get(i, "")) for i in range(len(self.raw))]
        whole = {p for p in self.ids if set(p) != {MARK} and self.merge(p) == [self.ids[p]]} | {MARK}
        for p in whole:
            self.automaton.add_word(p, (self.ids[p], len(p)))
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in whole:
                    self.shorter[self.ids[p]] = self.ids[p[:k]]
                    break
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.chunks = _Chunks(self)

    def merge(self, text: str) -> list[int]:
        """Merges outright: best score first, leftmost of equal ones."""
        n, score = len(text), self.score
        sym: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if sym[i] else n
            if j >= n or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := p + sym[after[j]]) in score:
                    heapq.heappush(heap, (-score[q], i, q))
            if before[i] >= 0 and (q := sym[before[i]] + p) in score:
                heapq.heappush(heap, (-score[q], before[i], q))
        out: list[int] = []
        for s in sym:
            if s:
                out += [self.ids[s]] if s in self.ids else [self.byte_id[b] for b in s.encode()]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the pieces a and b come out again when their characters are merged afresh."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            both = self.piece[a] + self.piece[b]
            known = self.fits[key] = both not in self.ids and self.merge(both) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        """The ids of a chunk all of whose characters are pieces and in which no scores tie."""
        n = len(text)
        longest, best = [0] * n, [0] * n
        for end, (piece, size) in self.automaton.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1], best[end - size + 1] = size, piece
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        fits, size, shorter = self.fits, self.size, self.shorter
        at, piece, last = 0, best[0], -1
        while True:
            end = at + size[piece]
            good = not failed[end >> 3] >> (end & 7) & 1
            if good and last >= 0:
                good = fits.get(last << 32 | piece)
                if good is None:
                    good = self.compatible(last, piece)
            if good:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, best[end]
            elif (cut := shorter[piece]) >= 0:
                piece = cut
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]
                last = out[-1] if out else -1

    def chunk(self, text: str) -> list[int]:
        if text[:2] == MARK * 2:
            return self.merge(text)
        if self.chars.issuperset(text):
            return self.backtrack(text)
        out: list[int] = []
        begin = 0
        for k, c in enumerate(text):
            if c not in self.ids:
                out += self.backtrack(text[begin:k]) if k > begin else []
                out += [self.byte_id[b] for b in c.encode()]
                begin = k + 1
        return out + (self.backtrack(text[begin:]) if begin < len(text) else [])

    def encode_array(self, text: str) -> bytes:
        """The ids as little-endian int32."""
        if not text:
            return b""
        return b"".join(map(self.chunks.__getitem__, _CUT.findall(MARK + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_array(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 become U+FFFD one by one."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        if ids and data[:1] == b" " and not self.is_byte[ids[0]]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _each_byte(data)


def _each_byte(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


_CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


class _Chunks(dict):
    """Encoded chunks as bytes, in two generations: what was not asked for during one is forgotten."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = np.array(self.model.chunk(text), "<i4").tobytes()
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


def model(path: str) -> PieceModel:
    """One for each worker."""
    return held(("pieces", path), lambda: PieceModel(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            ids, decoded, offsets = [], [], [0]
            for t in b.column("text"):
                one = m.encode_array(t.as_py() or "")
                ids.append(one)
                offsets.append(offsets[-1] + len(one) // 4)
                decoded.append(m.decode(np.frombuffer(one, "<i4").tolist()))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        tidy()

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (the text that the ids stand for) for every row."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_encode(path), "doc_id long, ids array<int>, decoded string")
