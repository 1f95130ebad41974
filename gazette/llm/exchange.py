"""Fingerprints that stand more than once anywhere: found by owners of ranges, told to the senders as bitmaps.

A sender has a set of 48-bit fingerprints. Each owner gets the different ones of its
range, sorted, as Golomb-Rice coded gaps from the range's begin, and a bit for each that says
whether the sender has it more than once. A fingerprint that all rows share so costs
an owner one entry a sender, not one a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PRINT_BITS = 48
#: Fingerprints of an owner at most, on average: what one task sorts. There are as many owners as that takes.
OWNED = 8_000_000


def golomb_encode(values: np.ndarray, base: int = 0) -> bytes:
    """Sorted unsigned values, base or more, as gaps: quotients in unary, then remainders of k bits; k fits the mean gap."""
    values = values.astype(np.uint64) - np.uint64(base)
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values) if len(values) else 0
    k = max(0, mean.bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    size = -(-k // 8)
    rest = np.unpackbits((gaps << np.uint64(8 * size - k)).astype(">u8").view(np.uint8).reshape(len(gaps), 8)[:, 8 - size :], axis=1)[:, :k] if k else np.zeros(0, np.uint8)
    head = np.array([len(values), k, len(unary)], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(data: bytes, base: int = 0) -> np.ndarray:
    n, k, bits = (int(x) for x in np.frombuffer(data, "<u8", 3))
    body = np.frombuffer(data, np.uint8, offset=24)
    cut = (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[:cut])[:bits])
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        size = -(-k // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - size :] = np.packbits(np.unpackbits(body[cut:])[: n * k].reshape(n, k), axis=1)
        gaps += wide.view(">u8").ravel().astype(np.uint64) >> np.uint64(8 * size - k)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    return ((prints >> np.uint64(PRINT_BITS - 32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def base_of(owner: int, owners: int) -> int:
    """No fingerprint of an owner is smaller."""
    return -(-(owner << 32) // owners) << (PRINT_BITS - 32)


def shares(different: np.ndarray, owners: int) -> list[tuple[int, slice]]:
    """The owners of sorted fingerprints, and where theirs stand."""
    cuts = np.searchsorted(owner_of(different, owners), np.arange(owners + 1))
    return [(int(k), slice(int(cuts[k]), int(cuts[k + 1]))) for k in np.flatnonzero(np.diff(cuts))]


def questions(different: np.ndarray, many: np.ndarray, owners: int) -> dict[str, list]:
    """Columns owner, prints, many: a row for each owner."""
    to = shares(different, owners)
    return {"owner": [k for k, _ in to], "prints": [golomb_encode(different[own], base_of(k, owners)) for k, own in to], "many": [np.packbits(many[own]).tobytes() for _, own in to]}


def answer(owners: int, sender: str):
    """applyInArrow over owner: (sender, owner, prints, many) in, (sender, owner, bits) out: which of a sender's fingerprints stand more than once anywhere."""

    def run(table: pa.Table) -> pa.Table:
        base = base_of(table.column("owner")[0].as_py(), owners)
        sent = [golomb_decode(m, base) for m in table.column("prints").to_pylist()]
        sizes = [len(x) for x in sent]
        own = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[:n] for m, n in zip(table.column("many").to_pylist(), sizes)])
        _, place, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        twice = (counts > 1) | (np.bincount(place, own) > 0)
        bits = np.split(twice[place], np.cumsum(sizes)[:-1])
        return pa.table({sender: table.column(sender), "owner": table.column("owner"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    return run


def marked(different: np.ndarray, owners: int, answers: dict[int, bytes]) -> np.ndarray:
    """Of a sender's different fingerprints: which stand more than once, by the owners' bitmaps."""
    hit = np.zeros(len(different), bool)
    for k, own in shares(different, owners):
        hit[own] = np.unpackbits(np.frombuffer(answers[k], np.uint8))[: own.stop - own.start].astype(bool)
    return hit
