"""Edit-aware token counts with a segment tree over each document's pre-tokens.

A byte-level BPE splits a text into pre-tokens and encodes each on its own, so a document's count is the sum over its
pre-tokens. Leaves of the tree hold characters and tokens of pre-tokens, inner nodes their sums. An edit finds its place by
characters, re-scans from up to two pre-tokens before it (whose matches may have looked at the edited characters) up
to the first boundary behind it that the old text has too, encodes only what is new there, and updates the sums above.
The shape of a tree stays: a leaf that takes in several pre-tokens holds them all, leaves merged away become empty.

tree_table() gives the trees of all documents, inner sums too, as columns to be kept in a table; apply_edits() takes them with the
edits and gives the edited texts, trees and counts without encoding or summing the rest again.

Defined cases. Null or empty text: no pre-tokens, 0 tokens. Edits beyond the end of the text: moved to its end; null edits or
edit texts: none, empty. Edits are applied one after another, each to the text that the former ones left. Null doc_id and
repeated rows: rows like any other. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import held, tidy
from gazette.staging import small_batches, stage

# The tokenizer's white space (Unicode White_Space) and the pre-token pattern over it.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers at most, and the longest one.
REMEMBERED, LONGEST = 200_000, 48
#: Children of an inner node.
ARITY = 8

split = regex.compile(PATTERN).findall


class Counter(dict):
    """Token counts of pre-tokens, in two generations: what was not asked for during one is forgotten."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=LIBRARY_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.old: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n


def counter(path: str) -> Counter:
    """One for each worker."""
    return held(("tokens", path), lambda: Counter(path))


def leaves(text: str, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token."""
    pieces = split(text)
    n = len(pieces)
    return np.fromiter(map(len, pieces), np.int32, n), np.fromiter(map(counts.__getitem__, pieces), np.int32, n)


def _summed(x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.arange(0, len(x), ARITY))


def level_sizes(total: int) -> list[int]:
    """Nodes of each level, leaves first, of a tree with so many nodes in all."""
    low, high = 0, total
    while True:  # the number of leaves whose levels add up to the total
        n = (low + high + 1) // 2
        sizes = [n]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // ARITY))
        if sum(sizes) == total:
            return sizes
        low, high = (n, high) if sum(sizes) < total else (low, n - 1)


class Tree:
    """Sums of characters and tokens over leaves; level 0 are the leaves, each next level sums ARITY nodes at a time."""

    def __init__(self, text: str, levels: list[tuple[np.ndarray, np.ndarray]], counts: Counter):
        self.text, self.levels, self.counts = text, levels, counts
        self.encoded = 0  # pre-tokens that edits have encoded

    @classmethod
    def over(cls, text: str, chars: np.ndarray, tokens: np.ndarray, counts: Counter) -> Tree:
        """The tree over these leaves."""
        levels = [(np.array(chars, np.int64), np.array(tokens, np.int64))]
        while len(levels[-1][0]) > 1:
            levels.append(tuple(_summed(x) for x in levels[-1]))
        return cls(text, levels, counts)

    @classmethod
    def kept(cls, text: str, chars: np.ndarray, tokens: np.ndarray, counts: Counter) -> Tree:
        """A tree from its table row: the sums of all levels in a line, leaves first, as they were written."""
        sizes, levels = level_sizes(len(chars)), []
        at = 0
        for n in sizes:
            levels.append((np.array(chars[at : at + n], np.int64), np.array(tokens[at : at + n], np.int64)))
            at += n
        return cls(text, levels, counts)

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][1].sum())

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and the character it begins with."""
        k, before = 0, 0
        for chars, _ in reversed(self.levels[:-1]):
            k *= ARITY
            last = min(k + ARITY, len(chars)) - 1
            while k < last and at - before >= chars[k]:
                before += int(chars[k])
                k += 1
        return k, before

    def _put(self, first: int, last: int, chars: int, tokens: int) -> None:
        """Leaf first takes the values, those up to last become empty; the sums above follow."""
        for values, new in zip(self.levels[0], (chars, tokens)):
            values[first : last + 1] = 0
            values[first] = new
        for below, above in zip(self.levels, self.levels[1:]):
            first, last = first // ARITY, last // ARITY
            for x, y in zip(below, above):
                y[first : last + 1] = _summed(x[ARITY * first : ARITY * (last + 1)])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start up to end by new."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        text = self.text
        self.text = text[:start] + new + text[end:]
        if not len(self.levels[0][0]):
            self.levels = Tree.over(self.text, *leaves(self.text, self.counts), self.counts).levels
            self.encoded += len(self.levels[0][0])
            return
        # A run of white space looks past its last character, at the next pre-token's first one: hence one leaf more.
        first, begin = self.find(max(start - 1, 0))
        if begin:
            first, begin = self.find(begin - 1)
        chars = self.levels[0][0]
        last, at = self.find(max(min(end, len(text) - 1), 0))
        stop = at + int(chars[last])  # where leaf last ends in the old text
        shift, width = len(new) - (end - start), 8
        while True:
            # Scan the new text up to the end of leaf last, and of some more behind it to see where old boundaries are met.
            more = min(last + width, len(chars) - 1)
            far = stop + int(chars[last + 1 : more + 1].sum())
            pieces = split(self.text[begin : far + shift])
            old, total, k = stop, begin, last
            for i, p in enumerate(pieces):
                total += len(p)
                while k < more and old + shift < total:
                    k += 1
                    old += int(chars[k])
                # A piece that ends where the scanned part ends may go on behind it.
                if total == old + shift and total >= start + len(new) and (total < far + shift or more == len(chars) - 1):
                    taken = pieces[: i + 1]
                    self.encoded += len(taken)
                    self._put(first, k, total - begin, sum(self.counts[x] for x in taken))
                    return
            if more == len(chars) - 1:  # nothing is left of the old text's end
                self.encoded += len(pieces)
                self._put(first, more, total - begin if pieces else 0, sum(self.counts[x] for x in pieces))
                return
            width *= 4

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums of all levels in a line, leaves first."""
        return tuple(np.concatenate(x) for x in zip(*self.levels))


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, arrays), np.int32, len(arrays))
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, pa.int32()))


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for b in batches:
            built = [Tree.over(t, *leaves(t, counts), counts).columns() for t in (x.as_py() or "" for x in b.column("text"))]
            rest = [n for n in b.schema.names if n not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), _ints([x[0] for x in built]), _ints([x[1] for x in built]), *[b.column(n) for n in rest]], ["doc_id", "text", "chars", "tokens", *rest])
        tidy()

    return run


TREES = "doc_id long, text string, chars array<int>, tokens array<int>"


def tree_table(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """doc_id, text, chars, tokens: each document's tree, the sums of all its levels in a line, leaves first; keep: further columns to carry."""
    small_batches(docs.sparkSession, 64)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in own.schema.fields[2:])
    return own.mapInArrow(_build(path), TREES + more)


EDITED = TREES + ", n_tokens long, n_tokens_edited long, n_reencoded long"
_NAMES = ["doc_id", "text", "chars", "tokens", "n_tokens", "n_tokens_edited", "n_reencoded"]


def _edit(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for b in batches:
            trees, before = [], []
            for t, c, n, todo in zip(*(b.column(k) for k in ("text", "chars", "tokens", "edits"))):
                tree = Tree.kept(t.as_py(), c.values.to_numpy(), n.values.to_numpy(), counts)
                before.append(tree.tokens)
                for e in todo.as_py() or ():
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "")
                trees.append(tree)
            sums = [t.columns() for t in trees]
            longs = [pa.array(x, pa.int64()) for x in (before, [t.tokens for t in trees], [t.encoded for t in trees])]
            texts = pa.array([t.text for t in trees], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, _ints([x[0] for x in sums]), _ints([x[1] for x in sums]), *longs], _NAMES)
        tidy()

    return run


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """trees: tree_table()'s columns and edits (array of struct start, end, text; code points, end exclusive).

    The edited text and its tree, n_tokens before, n_tokens_edited after, n_reencoded: pre-tokens that were encoded for the edits.
    """
    small_batches(trees.sparkSession, 64)
    edits = F.col("edits").cast("array<struct<start:bigint,end:bigint,text:string>>").alias("edits")
    return trees.select("doc_id", "text", "chars", "tokens", edits).mapInArrow(_edit(path), EDITED)


def count_with_edits(docs: DataFrame, path: str) -> DataFrame:
    """apply_edits() on the kept trees of docs (doc_id, text, edits): the table is written to the shared folder, and edits are applied to what is read from it."""
    return apply_edits(stage(tree_table(docs, path, "edits"), "token-trees", compression="zstd"), path)
