"""Static binary-fuse filters over 64-bit keys, built and probed with numpy.

Three positions a key in neighbouring segments, one fingerprint byte a slot, about 9 bits a key and a false positive
in 256. A filter is a byte string: a header of five integers and the fingerprints.
"""

from __future__ import annotations

import math

import numpy as np

HEADER = np.dtype([("seed", "<u8"), ("segment", "<u4"), ("spread", "<u8")])


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, spread: int) -> np.ndarray:
    first = ((h >> np.uint64(32)) * np.uint64(spread)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    spread = segments * segment
    seed = 0
    while True:
        seed += 0x9E3779B97F4A7C15
        h = _mixed(keys, seed % (1 << 64))
        places = _places(h, segment, spread)
        order = _peel(places, spread + 2 * segment)
        if order is not None:
            break
    table, prints = np.zeros(spread + 2 * segment, np.uint8), _prints(h)
    for members, at in reversed(order):
        table[at] = prints[members] ^ table[places[0, members]] ^ table[places[1, members]] ^ table[places[2, members]]
    return np.array([(seed % (1 << 64), segment, spread)], HEADER).tobytes() + table.tobytes()


def _peel(places: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each has to itself once the earlier rounds are gone), or None if some stay stuck."""
    count, owner = np.zeros(slots, np.int32), np.zeros(slots, np.int64)
    every = np.arange(places.shape[1])
    for row in places:
        np.add.at(count, row, 1)
        np.bitwise_xor.at(owner, row, every)
    rounds, left, frontier = [], len(every), np.flatnonzero(count == 1)
    while len(frontier):
        members, index = np.unique(owner[frontier], return_index=True)
        rounds.append((members, frontier[index]))
        left -= len(members)
        touched = places[:, members]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(owner, row, members)
        frontier = np.unique(touched[count[touched] == 1])
    return None if left else rounds


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key that was put in, and for one in 256 of the others."""
    head = np.frombuffer(filter_bytes[: HEADER.itemsize], HEADER)[0]
    table = np.frombuffer(filter_bytes, np.uint8, offset=HEADER.itemsize)
    h = _mixed(keys.astype(np.uint64), int(head["seed"]))
    a, b, c = _places(h, int(head["segment"]), int(head["spread"]))
    return _prints(h) == table[a] ^ table[b] ^ table[c]
