"""CRC-32C of many records at once, and the masked form that record files carry."""

from __future__ import annotations

import numpy as np

BLOCK = 256


def _tables() -> np.ndarray:
    """Tables for four bytes at a time, from the Castagnoli polynomial (reflected)."""
    t = np.zeros((4, 256), np.uint32)
    for v in range(256):
        c = v
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, v] = c
    for k in range(1, 4):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 255]
    return t


_T = _tables()


def _step(reg: np.ndarray) -> np.ndarray:
    """Four bytes further; the bytes are in ``reg`` already."""
    return _T[3][reg & 255] ^ _T[2][(reg >> 8) & 255] ^ _T[1][(reg >> 16) & 255] ^ _T[0][reg >> 24]


def _skip_tables() -> np.ndarray:
    """What BLOCK zero bytes make of a register, by byte of the register (the map is linear)."""
    reg = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(BLOCK // 4):
        reg = _step(reg)
    return reg.reshape(4, 256)


_SKIP = _skip_tables()


def crc32c(units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of records of 16-bit little-endian units; ``units`` holds them in a row, each at least one unit long.

    Records are padded in front to whole blocks (zeros before the start leave a zero register as it is; the initial ones are put into
    the first four bytes), all blocks advance together, and a record's blocks are folded in order. Records of one unit are stepped by byte.
    """
    per = BLOCK // 2
    blocks = -(-lengths // per)
    first = np.concatenate([[0], np.cumsum(blocks)])
    grid = np.zeros(int(first[-1]) * per, "<u2")
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = first[1:] * per - lengths
    grid[np.repeat(at - begin, lengths) + np.arange(len(units))] = units
    long = lengths > 1
    grid[at[long]] ^= np.uint16(0xFFFF)
    grid[at[long] + 1] ^= np.uint16(0xFFFF)
    grid = np.ascontiguousarray(grid.view("<u4").reshape(-1, BLOCK // 4).T)
    reg = np.zeros(grid.shape[1], np.uint32)
    for row in grid:
        reg = _step(reg ^ row)
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    for k in range(int(blocks.max(initial=0))):
        live = order[:np.searchsorted(-blocks[order], -k, "left")]
        o = out[live]
        out[live] = _SKIP[0][o & 255] ^ _SKIP[1][(o >> 8) & 255] ^ _SKIP[2][(o >> 16) & 255] ^ _SKIP[3][o >> 24] ^ reg[first[live] + k]
    one = np.full(int((~long).sum()), 0xFFFFFFFF, np.uint32)
    for shift in (0, 8):
        one = _T[0][(one ^ (units[begin[~long]].astype(np.uint32) >> shift)) & 255] ^ (one >> 8)
    out[~long] = one
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
