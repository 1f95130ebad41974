"""License scan by ordered signature rules.

A text becomes a row of words (ASCII letters lower-cased; digits and all characters beyond
ASCII belong to words). One Aho-Corasick pass over the words finds the keywords
present; a rule's regular expression runs only if one of its keywords is. Detections are settled
by priority: from the highest level down, a detection that lies within one already
accepted is suppressed, so that "gpl-3.0-or-later" silences "gpl-3.0" and "gpl" at its place.

The rules, some five hundred, are written out in license_rules.py, each with a text that it is for.
The base phrases are found besides and always reported. A rule without a keyword runs on every text.

Defined cases. Null or empty text: no words, no places, null first and last word, empty
labels, score 0. Repeated rows: each a row. Null doc_id: carried. Empty table: empty
result. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import license_rules as written
from gazette.llm.common import held
from gazette.staging import small_batches

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Levels of priority, from verbatim grants down to mere mentions; each with the score of a detection.
GRANT, TAG, VERSION, NAME, MENTION = range(5)
SCORES = (1.0, 0.95, 0.9, 0.75, 0.4)


@dataclass(frozen=True)
class Rule:
    level: int
    label: str
    pattern: str  # over words parted by one space
    keywords: tuple[str, ...]  # one of them must occur as a part of some word


#: A group, what follows it as its number of times, or a literal character that may be missing, or one of several.
_PART = re.compile(r"(?P<group>\((?:[^()]|\([^()]*\))*\))(?P<times>[?*+]|\{\d+,?\d*\})?|\[[^\]]*\][?*+]?|\\w[?*+]?|[\w ][?*]")


#: Words that tell little of a license, as texts of all kinds hold them.
ORDINARY = {"only", "later", "newer", "version", "license", "licence", "licen", "public", "software", "open", "general", "details", "under", "terms", "this"}


def _alternatives(pattern: str) -> list[str]:
    depth, start, parts = 0, 0, []
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
    return parts


def _keywords(pattern: str) -> tuple[str, ...]:
    """For each alternative of a pattern a word, or those of a group's alternatives, that every match holds; the longest there are, of ordinary words last. None if one has none."""
    found: list[str] = []
    for part in _alternatives(pattern):
        choices = [(w,) for w in _PART.sub("\0", part).replace("\0", " ").split() if len(w) > 1]
        for m in _PART.finditer(part):
            if m["group"] and not (m["times"] or "+").startswith(("?", "*", "{0")):
                choices.append(_keywords(m["group"][1:-1].removeprefix("?:")))
        choices = [c for c in choices if c]
        if not choices:
            return ()
        found += max(choices, key=lambda c: (not ORDINARY & {*c}, min(map(len, c))))
    return tuple(dict.fromkeys(found))


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""
    levels = ((GRANT, written.GRANTS), (TAG, written.TAGS), (VERSION, written.VERSIONS), (NAME, written.NAMES), (MENTION, written.MENTIONS))
    return tuple(Rule(level, label, pattern, _keywords(pattern)) for level, own in levels for label, pattern, _ in own)


class Scanner:
    def __init__(self, table: tuple[Rule, ...] | None = None):
        self.rules = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in table or rules()]
        self.always = [i for i, (r, _) in enumerate(self.rules) if not r.keywords]
        self.by_keyword: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            for k in r.keywords:
                self.by_keyword.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k in [*self.by_keyword, *(max(p.split(), key=len) for p in BASE)]:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()
        every = bytes(range(256))
        wordy = lambda c: 48 <= c < 58 or 97 <= c < 123 or c > 127
        self.table = bytes(c if wordy(c) else 32 for c in every.lower())

    def words(self, text: str) -> list[bytes]:
        return text.encode().translate(self.table).split(b" ")

    def scan(self, text: str) -> dict:
        words = [w for w in self.words(text) if w]
        out = {"n_words": len(words), "places": [], "found": []}
        line = b" ".join([b"", *words, b""]).decode()
        present = {k for _, k in self.automaton.iter(line)}
        if not present and not self.always:
            return out
        index = _Index(line)
        for phrase, label in BASE.items():
            at = line.find(f" {phrase} ")
            while at >= 0:
                out["places"].append((index.word(at + 1), label))
                at = line.find(f" {phrase} ", at + 1)
        chosen = sorted({i for k in present for i in self.by_keyword.get(k, ())} | set(self.always))
        spans = []
        for i in chosen:
            rule, pattern = self.rules[i]
            spans += [(rule.level, index.word(m.start()), index.word(m.end() + 1), rule.label) for m in pattern.finditer(line)]
        out["found"] = settle(spans)
        return out


class _Index:
    """Word numbers of character positions in a line of words, counted on from where the last question left off."""

    def __init__(self, line: str):
        self.line, self.at, self.n = line, 0, 0

    def word(self, at: int) -> int:
        if at >= self.at:
            self.n += self.line.count(" ", self.at, at)
        else:
            self.n -= self.line.count(" ", at, self.at)
        self.at = at
        return self.n - 1


def settle(spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(level, start, end, label) that are not contained in an accepted one of a higher level, or a wider one of their own."""
    accepted: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    reach: list[int] = []  # the farthest end of accepted spans up to each start
    for level in sorted({s[0] for s in spans}):
        new, far, last = [], -1, None
        for s in sorted({s for s in spans if s[0] == level}, key=lambda s: (s[1], -s[2], s[3])):
            k = bisect_right(starts, s[1]) - 1
            within = k >= 0 and reach[k] >= s[2]
            if not within and (s[2] > far or (last and s[1:3] == last[1:3])):
                new.append(s)
                far, last = max(far, s[2]), s
        accepted += new
        order = sorted(accepted, key=lambda s: s[1])
        starts, reach, top = [s[1] for s in order], [], -1
        for s in order:
            top = max(top, s[2])
            reach.append(top)
    return sorted(accepted, key=lambda s: (s[1], s[2], s[0], s[3]))


def scanner() -> Scanner:
    return held("licenses", Scanner)


SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = scanner()
    for b in batches:
        got = [s.scan(t.as_py() or "") for t in b.column("text")]
        places = [[{"label": x, "start": at} for at, x in sorted(g["places"])] for g in got]
        found = [[{"label": x, "start": a, "end": z, "score": SCORES[level]} for level, a, z, x in g["found"]] for g in got]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([g["n_words"] for g in got], pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(found, pa.list_(SPAN))], ["doc_id", "n_words", "places", "detections"]
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (base phrases: label, start), detections (label, start, end in words, score) of every row."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan, "doc_id long, n_words long, places array<struct<label string, start long>>, detections array<struct<label string, start long, end long, score double>>")
