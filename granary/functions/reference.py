"""Sizes under the standard library's codecs."""

from __future__ import annotations

import lzma

import numpy as np

#: Bits of the hash of four bytes by which level 9 of LZMA finds matches, bits that smaller dictionaries leave of it, and how
#: many earlier places a search looks at. A dictionary of twice as many bytes has a table of so many bits.
FULL_BITS, FEWER_BITS, DEPTH = 24, (16, 20, 22), 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def enough_bits(data: bytes) -> int:
    """Bits of hash with which a search surely finds what it finds with all of them.

    Places share a tree by their hash. With fewer bits trees are merged; a merged tree holds other places too, but they
    have other first bytes, so they lie beyond those that match and hide none. They only count against the depth of a
    search, which a tree of at most DEPTH places can't use up.
    """
    if len(data) < 4:
        return FEWER_BITS[0]
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    full = (_CRC[a[:-3]] ^ a[1:-2] ^ a[2:-1] << 8 ^ _CRC[a[3:]] << 5) & np.uint32((1 << FULL_BITS) - 1)
    trees, places = np.unique(full, return_counts=True)
    for bits in FEWER_BITS:
        if len(data) > 2 << bits:
            continue
        low = trees & np.uint32((1 << bits) - 1)
        order = np.argsort(low, kind="stable")
        cuts = np.flatnonzero(np.diff(low[order], prepend=-1))
        merged = np.diff(np.r_[cuts, len(low)]) > 1
        if (np.add.reduceat(places[order], cuts)[merged] <= DEPTH).all():
            return bits
    return FULL_BITS


def lzma_size(data: bytes) -> int:
    """The size of lzma.compress(data, preset=9), which clears 64 MB of tables for any file; smaller ones where they give the same."""
    if (bits := enough_bits(data)) == FULL_BITS:
        return len(lzma.compress(data, preset=9))
    return len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9, "dict_size": 2 << bits}]))
