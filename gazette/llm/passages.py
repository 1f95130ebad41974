"""Passages that stand elsewhere already, word for word: repeated windows found by level-wise doubling.

Texts are written once, as words, in chunks of some megabytes, bucketed by chunk, so
that each level reads a chunk's texts beside what was found out about them without
shuffling them again. The first level asks of every window of a few words whether it
stands more than once anywhere. Only where two such windows follow each other can a
window of twice that length do so: these are asked about next, and so on, until no
candidate survives or the length is reached at which passages count. There owners
compare 96 bits of each different window and answer whether it also starts earlier.
Questions are fingerprints sent to the owners of ranges, answers bitmaps (exchange.py).

Defined cases. Null or empty text: no words. Null doc_id: later than every id. Rows
that share a doc_id: in the order in which the texts were written; of equal rows one
is the earliest. Empty table: empty result. Other columns are ignored, whatever their
names. Texts of any length are read whole; a chunk holds one text at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # a worker that has not loaded it otherwise lacks it
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import text_of, tidy
from gazette.llm.exchange import OWNED, PRINT_BITS, answer, base_of, golomb_decode, golomb_encode, marked, questions, shares
from gazette.llm.words import hashes, mixed, places, text_bytes
from gazette.staging import discard, stage, stage_bucketed

#: Bytes of texts in a chunk, and the fewest words of the first level's windows.
CHUNK, SHORTEST = 12 << 20, 5
_REST = np.uint64((1 << (64 - PRINT_BITS)) - 1)


def levels(length: int) -> list[int]:
    """Lengths from a short one to length, each twice the one before."""
    steps = [length]
    while steps[0] % 2 == 0 and steps[0] // 2 >= SHORTEST:
        steps.insert(0, steps[0] // 2)
    return steps


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, n = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        at = text_bytes(b.column("text"))[1]
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(at, at[begin] + CHUNK - n, "right")) - 1
            if end <= begin and n:  # the next text begins another chunk
                chunk, n = chunk + 1, 0
                continue
            end = max(end, begin + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(end - begin, chunk)), b.column("doc_id")[begin:end], b.column("text")[begin:end]], ["chunk", "doc_id", "text"])
            n += int(at[end] - at[begin])
            begin = end
    tidy()


class _Chunk:
    """A chunk's words and the hashes of its windows; documents in the order of their ids."""

    def __init__(self, table: pa.Table, owners: int):
        ids = table.column("doc_id").combine_chunks()
        self.table = table.take(pa.compute.array_sort_indices(ids))  # nulls last; equal ids stay in their order
        self.data, self.at = text_bytes(self.table.column("text").combine_chunks())
        self.begins, self.ends, self.doc = places(self.data, self.at)
        self.owners = owners
        self.room = np.searchsorted(self.doc, self.doc, "right") - np.arange(len(self.doc))
        self.lanes: dict[int, list[np.ndarray]] = {}
        self.length = 0

    def start(self, length: int, lane: int = 0) -> np.ndarray:
        """Hashes of all windows of the first level's length, at every word that has room for one."""
        words = hashes(self.data, self.begins, self.ends, lane)
        h = words[: max(0, len(words) - length + 1)].copy()
        for k in range(1, length):
            h = mixed(h, words[k : k + len(h)])
        return h

    def follow(self, done: list[tuple[int, dict[int, bytes]]], level: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the windows of level that are asked about, and their hashes; done: the levels before, and their answers."""
        lengths = [x for x, _ in done] + [level]
        h = self.start(lengths[0])
        at = np.flatnonzero(self.room[: len(h)] >= lengths[0])
        self.survived = []
        for (length, told), longer in zip(done, lengths[1:]):
            different, place = np.unique(h[at] >> np.uint64(64 - PRINT_BITS), return_inverse=True)
            at = at[marked(different, self.owners, told)[place]]
            self.survived.append((length, at))
            there = np.zeros(len(self.doc) + length, bool)
            there[at] = True
            at = at[there[at + length]]
            at = at[self.room[at] >= longer]
            h = mixed(h[:-length], h[length:]) if len(h) > length else h[:0]
        return at, h

    def check(self, lengths: list[int], at: np.ndarray) -> np.ndarray:
        """Another 64 bits of the windows of the last of lengths that begin at at."""
        h = self.start(lengths[0], 1)
        for length in lengths[:-1]:
            h = mixed(h[:-length], h[length:]) if len(h) > length else h[:0]
        return h[at]

    def different(self, lengths: list[int], at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at at: hash, 48 further bits and first word of each different one, sorted by hash and these bits."""
        keys, more = h[at], self.check(lengths, at) >> np.uint64(32)
        more |= (keys & _REST) << np.uint64(32)
        order = np.lexsort((at, more, keys >> np.uint64(64 - PRINT_BITS)))
        keys, more, at = keys[order] >> np.uint64(64 - PRINT_BITS), more[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
        return keys[new], more[new], at[new]


def _told(answers: pa.Table | None, done: list[int], column: str = "bits") -> list[tuple[int, dict[int, bytes]]]:
    """The answers by level, in their order."""
    out: dict[int, dict[int, bytes]] = {x: {} for x in done}
    if answers is not None:
        for level, owner, bits in zip(*(answers.column(c).to_pylist() for c in ("level", "owner", column))):
            out[level][owner] = bits
    return [(x, out[x]) for x in done]


ASKED = "chunk long, owner int, prints binary, many binary"


def _ask(owners: int, done: list[int], level: int):
    """The questions of one level: different fingerprints of its candidates."""

    def run(texts: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "owner": pa.array([], pa.int32()), "prints": pa.array([], pa.binary()), "many": pa.array([], pa.binary())})
        own = _Chunk(texts, owners)
        at, h = own.follow(_told(answers, done), level)
        different, counts = np.unique(h[at] >> np.uint64(64 - PRINT_BITS), return_counts=True)
        q = questions(different, counts > 1, owners)
        n = len(q["owner"])
        out = pa.table({"chunk": pa.array([texts.column("chunk")[0].as_py()] * n, pa.int64()), "owner": pa.array(q["owner"], pa.int32()), "prints": pa.array(q["prints"], pa.binary()), "many": pa.array(q["many"], pa.binary())})
        tidy()
        return out

    return run


PLACED = "chunk long, owner int, prints binary, more binary, first binary, docs binary, ids binary, nulls long"


def _ask_places(owners: int, done: list[int], level: int):
    """The questions of the level that decides: different windows with 96 bits, and the first place of each."""

    def run(texts: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        rows = {c.split()[0]: [] for c in PLACED.split(", ")}
        if texts.num_rows:
            own = _Chunk(texts, owners)
            at, h = own.follow(_told(answers, done), level)
            keys, more, first = own.different([*done, level], at, h)
            ids = own.table.column("doc_id").combine_chunks()
            known = ids.drop_null().to_numpy().astype("<i8")
            begin = np.searchsorted(own.doc, np.arange(len(ids))).astype("<u4")
            for k, part in shares(keys, owners):
                m = more[part]
                six = m.astype("<u8").view(np.uint8).reshape(len(m), 8)[:, :6]
                row = (texts.column("chunk")[0].as_py(), k, golomb_encode(keys[part], base_of(k, owners)), six.tobytes(), first[part].astype("<u4").tobytes(), begin.tobytes(), known.tobytes(), ids.null_count)
                for c, v in zip(rows, row):
                    rows[c].append(v)
        tidy()
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.table({c.split()[0]: pa.array(rows[c.split()[0]], kinds[c.split()[1]]) for c in PLACED.split(", ")})

    return run


def _answer_places(owners: int, level: int):
    """One owner: which different windows stand more than once, and which also start earlier than where the sender has them first."""

    def run(table: pa.Table) -> pa.Table:
        base, cols = base_of(table.column("owner")[0].as_py(), owners), {c: table.column(c).to_pylist() for c in table.column_names}
        keys, more, order = [], [], []
        for chunk, prints, six, first, docs, ids in zip(*(cols[c] for c in ("chunk", "prints", "more", "first", "docs", "ids"))):
            keys.append(golomb_decode(prints, base))
            wide = np.zeros((len(keys[-1]), 8), np.uint8)
            wide[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
            more.append(wide.view("<u8").ravel())
            place = np.frombuffer(first, "<u4").astype(np.int64)
            doc = np.searchsorted(np.frombuffer(docs, "<u4"), place, "right") - 1
            known = np.frombuffer(ids, "<i8")
            null = doc >= len(known)
            id_of = np.where(null, 0, known[np.minimum(doc, len(known) - 1)]) if len(known) else np.zeros(len(doc), np.int64)
            order.append(np.stack([null, id_of, np.full(len(doc), chunk), place]))
        sizes = [len(k) for k in keys]
        keys, more, order = np.concatenate(keys), np.concatenate(more), np.concatenate(order, axis=1)
        sort = np.lexsort((*order[::-1], more, keys))
        new = np.ones(len(sort), bool)
        new[1:] = (keys[sort[1:]] != keys[sort[:-1]]) | (more[sort[1:]] != more[sort[:-1]])
        later = np.zeros(len(sort), bool)
        later[sort] = ~new
        return pa.table({"chunk": pa.array(cols["chunk"], pa.int64()), "level": pa.array([level] * len(sizes), pa.int32()), "owner": pa.array(cols["owner"], pa.int32()),
                         "bits": pa.array([np.packbits(b).tobytes() for b in np.split(later, np.cumsum(sizes)[:-1])], pa.binary())})

    return run


RESULT = "doc_id long, n_words long, n_removed long, longest int, text string"


def _cover(owners: int, done: list[int], level: int):
    """Each text without the words under windows that also start earlier."""

    def run(texts: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "longest": pa.array([], pa.int32()), "text": pa.array([], pa.string())})
        own = _Chunk(texts, owners)
        told = dict(_told(answers, [*done, level]))
        at, h = own.follow([(x, told[x]) for x in done], level)
        n = len(own.doc)
        gone = np.zeros(n + 1, np.int32)
        longest = np.zeros(texts.num_rows, np.int32)
        for length, survivors in own.survived:
            longest[own.doc[survivors]] = length
        if len(at) and told[level]:
            keys, more, first = own.different([*done, level], at, h)
            later = np.zeros(len(keys), bool)
            for k, part in shares(keys, owners):
                later[part] = np.unpackbits(np.frombuffer(told[level][k], np.uint8))[: part.stop - part.start].astype(bool)
            stays = np.zeros(n, bool)
            stays[first[~later]] = True
            away = at[~stays[at]]
            np.add.at(gone, away, 1)
            np.add.at(gone, away + level, -1)
            longest[own.doc[away]] = level
        keep = np.cumsum(gone[:-1]) == 0
        words = np.bincount(own.doc, minlength=texts.num_rows)
        kept = np.bincount(own.doc[keep], minlength=texts.num_rows)
        # Each kept word with a space behind it, but for a text's last one.
        last = np.zeros(n, bool)
        held = np.flatnonzero(keep)
        last[held[np.searchsorted(own.doc[held], np.flatnonzero(kept), "right") - 1]] = True
        data = np.append(own.data, np.uint8(32))
        size = np.where(keep, own.ends - own.begins + ~last, 0)
        joined = np.empty(int(size.sum()), np.uint8)
        out_at = np.concatenate([[0], np.cumsum(size)])
        mask = np.zeros(len(data) + 1, np.int8)
        np.add.at(mask, own.begins[keep], 1)
        np.add.at(mask, own.ends[keep], -1)
        inside = np.cumsum(mask[:-1]).astype(bool)
        spaces = np.zeros(len(joined), bool)
        spaces[out_at[1:][keep & ~last] - 1] = True
        joined[spaces] = 32
        joined[~spaces] = data[inside]
        ends = np.concatenate([[0], np.cumsum(np.bincount(own.doc, size, texts.num_rows).astype(np.int64))])
        text = pa.LargeStringArray.from_buffers(texts.num_rows, pa.py_buffer(ends), pa.py_buffer(joined)).cast(pa.string())
        tidy()
        return pa.table({"doc_id": own.table.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(words - kept, pa.int64()), "longest": pa.array(longest), "text": text})

    return run


def without_repeats(docs: DataFrame, length: int = 20, owners: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, longest, text for every row: the text's words that are under no window of length words which also starts earlier.

    Earlier is a smaller doc_id, or an earlier place in the same document; windows are judged on the input. longest: the longest
    length of a level of which some window of the document stands more than once (0: none); at length itself, of one that is removed.
    """
    spark = docs.sparkSession
    # Words joined by one space.
    text = F.btrim(F.regexp_replace(text_of().cast("string"), r"[\x20\x09-\x0D]+", " "))
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_chunked, "chunk long, doc_id long, text string")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = stage_bucketed(flat, "passage-texts", partitions, "chunk")
    total = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)).first()[0] or 0  # one number
    owners = owners or max(partitions, -(-total // OWNED))
    grouped, answers, done = texts.groupBy("chunk"), None, []

    def each(f, schema):
        return grouped.applyInArrow(lambda t: f(t), schema) if answers is None else grouped.cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)

    for level in levels(length):
        if level == length:
            asked = each(_ask_places(owners, list(done), level), PLACED)
            new = asked.groupBy("owner").applyInArrow(_answer_places(owners, level), "chunk long, level int, owner int, bits binary")
        else:
            asked = each(_ask(owners, list(done), level), ASKED)
            new = asked.groupBy("owner").applyInArrow(answer(owners, "chunk"), "chunk long, owner int, bits binary")
            new = new.select("chunk", F.lit(level).cast("int").alias("level"), "owner", "bits")
        both = stage(new if answers is None else answers.unionByName(new), "passage-answers")
        if answers is not None:
            discard(answers)
        answers = both
        if level == length or answers.where(F.col("level") == level).isEmpty():
            break  # decided, or no candidate survives
        done.append(level)
    return each(_cover(owners, done, level), RESULT)
