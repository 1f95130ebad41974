"""Fill-in-the-middle: texts are cut at two code points and their parts put into another order.

The bytes of a batch of texts are stored as maximal runs of one character class (how
many UTF-8 bytes a character takes), each with the number of its first byte and of
its first unit (code point). A cut is given in units: binary search finds the run
that holds it, and its byte is the run's first one plus the units behind it times
the class. Lengths in units come from the same table, searched by bytes. No text is
decoded, and a text of one class is one run however long it is.

Defined cases. Null text: the empty text, form plain. Null doc_id: drawn as the
empty id. Repeated rows and ties: each row is cut as its id says. Texts that hold a
mark are left plain, so marks stand only where they were put and every text comes
back exactly. Empty table: empty result. Other columns are ignored, whatever their
names. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import text_of, tidy
from gazette.llm.words import text_bytes

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes whose characters are looked at together, and bytes of output in one batch.
BLOCK, OUTPUT = 1 << 20, 1 << 24
#: The class of a character by its first byte; 0 is a byte inside a character.
CLASS = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [128, 64, 32, 16, 16])


class Runs(NamedTuple):
    """First byte, first unit and class of each run, and behind the last one a run that begins where all ends."""

    byte: np.ndarray
    unit: np.ndarray
    size: np.ndarray

    def byte_at(self, units: np.ndarray) -> np.ndarray:
        r = np.searchsorted(self.unit, units, "right") - 1
        return self.byte[r] + (units - self.unit[r]) * self.size[r]

    def unit_at(self, firsts: np.ndarray) -> np.ndarray:
        """The unit that begins at each byte."""
        r = np.searchsorted(self.byte, firsts, "right") - 1
        return self.unit[r] + (firsts - self.byte[r]) // self.size[r]


def class_runs(data: np.ndarray) -> Runs:
    """The runs of UTF-8 bytes."""
    found, units, last = [], 0, 0
    for begin in range(0, len(data), BLOCK):
        kinds = CLASS[data[begin : begin + BLOCK]]
        leads = np.flatnonzero(kinds)
        kinds = kinds[leads]
        new = np.flatnonzero(np.diff(kinds, prepend=np.uint8(last)))
        found.append((begin + leads[new], units + new, kinds[new]))
        units += len(leads)
        last = kinds[-1] if len(kinds) else last
    found.append((np.array([len(data)]), np.array([units]), np.array([1])))
    return Runs(*(np.concatenate(x).astype(np.int64) for x in zip(*found)))


def _cut(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, at = text_bytes(b.column("text"))
            runs = class_runs(data)
            first = runs.unit_at(at)
            n = np.diff(first)
            cuts = np.sort(np.stack([b.column(c).to_numpy() % (n + 1) for c in ("draw1", "draw2")]), axis=0)
            one, two = runs.byte_at(first[:-1] + cuts[0]), runs.byte_at(first[:-1] + cuts[1])
            forms = b.column("form").to_pylist()
            plain = np.array([f == "plain" for f in forms])
            sizes = np.diff(at) + np.where(plain, 0, len(p) + len(s) + len(m))
            view, begin = memoryview(data), 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), OUTPUT)) + begin)
                parts = []
                for k in range(begin, end):
                    a, c, d, z = at[k], one[k], two[k], at[k + 1]
                    if forms[k] == "plain":
                        parts.append(view[a:z])
                    elif forms[k] == "psm":
                        parts += (p, view[a:c], s, view[d:z], m, view[c:d])
                    else:
                        parts += (s, view[d:z], p, view[a:c], m, view[c:d])
                ends = np.concatenate([[0], np.cumsum(sizes[begin:end])])
                out = pa.LargeStringArray.from_buffers(end - begin, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(parts))).cast(pa.string())
                own = slice(begin, end)
                counted = [pa.array(x[own], pa.int64(), mask=plain[own]) for x in (cuts[0], cuts[1] - cuts[0])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[own], pa.array(n[own], pa.int64()), b.column("form")[own], *counted, out], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                begin = end
        tidy()

    return run


def fill_in_middle(docs: DataFrame, marks: tuple[str, str, str] = MARKS, changed: int = 90, suffix_first: int = 20, salt: str = "1:") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output for every row.

    A document's draws are the first four groups of eight hex digits of the SHA-256 of salt and doc_id: the two cuts, then
    whether the text is changed (changed of 100), then whether its suffix comes first (suffix_first of 100: form spm, else psm).
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"), digest.alias("digest"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    kept = (F.col("text") == "") | marked | (draw(3) % 100 >= changed)
    form = F.when(kept, "plain").when(draw(4) % 100 < suffix_first, "spm").otherwise("psm")
    drawn = own.select("doc_id", "text", draw(1).alias("draw1"), draw(2).alias("draw2"), form.alias("form"))
    return drawn.mapInArrow(_cut(marks), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle() was given: the parts between the marks, in their order."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(one) + len(first) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
