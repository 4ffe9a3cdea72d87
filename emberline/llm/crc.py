"""CRC-32 of spans of bytes, and the algebra that composes the CRC of a text from those of its parts.

A CRC is linear over GF(2): the CRC of A followed by B is the CRC of A, moved on by the length of B, xor the CRC of B. To move on
by a length is to multiply by a matrix of 32 by 32 bits; those of all powers of two suffice.
"""

from __future__ import annotations

import zlib

import numpy as np

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Spans of more bytes are given to zlib one by one, so that one long word isn't thousands of small steps.
LONG_SPAN = 64
#: Lengths under 2 ** POWERS can be moved on by.
POWERS = 31


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_BYTE = _byte_table()


def _lookup(columns: np.ndarray) -> np.ndarray:
    """A matrix, given by its 32 columns, as four tables: what each value of each byte of a vector is mapped to."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        has = (np.arange(256) >> (k % 8)) & 1 == 1
        out[k // 8, has] ^= columns[k]
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shift_tables() -> list[np.ndarray]:
    """The matrices that move a CRC on by 1, 2, 4, ... bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = _BYTE[unit & 255] ^ (unit >> 8)
    out = []
    for _ in range(POWERS):
        out.append(_lookup(columns))
        columns = _times(out[-1], columns)
    return out


_SHIFTS = _shift_tables()


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC, moved on by its length in bytes."""
    out, lengths = crcs.astype(np.uint32), np.broadcast_to(lengths, crcs.shape)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        odd = np.flatnonzero((lengths >> k) & 1)
        out[odd] = _times(_SHIFTS[k], out[odd])
    return out


def combine(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """The CRC of each left text followed by its right text."""
    return shift(left, right_length) ^ right


def of_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each buf[start:end], a byte of all spans at a time."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    crc, at, left = np.full(len(live), 0xFFFFFFFF, np.uint32), starts[live], size[live]
    while len(live):
        crc = _BYTE[(crc ^ buf[at]) & 255] ^ (crc >> 8)
        at, left = at + 1, left - 1
        if (over := left == 0).any():
            out[live[over]] = ~crc[over]
            live, crc, at, left = live[~over], crc[~over], at[~over], left[~over]
    return out


def of_runs(word_crcs: np.ndarray, sizes: np.ndarray, last: np.ndarray, most: int):
    """For n = 1 to ``most``: (first words, CRCs) of all runs of n words joined by one space.

    ``last``: for each word, the index of the last word of its text; no run goes beyond. Strings of runs are never made.
    """
    first, crc = np.arange(len(word_crcs)), word_crcs
    yield first, crc
    blank = np.uint32(zlib.crc32(b" "))
    spaced = combine(np.full(len(word_crcs), blank), word_crcs, sizes) if most > 1 else None
    for n in range(1, most):
        on = first + n <= last[first]
        first, crc = first[on], crc[on]
        crc = combine(crc, spaced[first + n], sizes[first + n] + 1)
        yield first, crc
