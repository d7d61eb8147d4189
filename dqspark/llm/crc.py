"""CRC-32 of many byte ranges of one stream, from its running CRCs."""

from __future__ import annotations

import functools

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32
INVERTED = np.uint32(0xFFFFFFFF)
SIDE = 64                # bytes that each lane of the stream is advanced, all lanes side by side


@functools.cache
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@functools.cache
def _shift_tables(power: int) -> np.ndarray:
    """Four tables of 256: what a register becomes after ``2 ** power`` zero bytes, byte by byte of the register."""
    if power == 0:
        zero = _byte_table()
        place = np.arange(256, dtype=np.uint32)
        return np.stack([zero, place, place << np.uint32(8), place << np.uint32(16)])
    half = _shift_tables(power - 1)
    return _apply(half, half)


def _apply(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    r = registers
    return (tables[0][r & 255] ^ tables[1][(r >> 8) & 255] ^ tables[2][(r >> 16) & 255] ^ tables[3][r >> 24])


def shifted(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after as many zero bytes as its length: a product over GF(2) for each bit of the length."""
    out = registers.astype(np.uint32)
    lengths = np.broadcast_to(np.asarray(lengths, np.int64), out.shape)
    power, left = 0, int(lengths.max(initial=0))
    while left >> power:
        of = np.flatnonzero((lengths >> power) & 1)
        out[of] = _apply(_shift_tables(power), out[of])
        power += 1
    return out


class Prefixes:
    """Registers of a byte stream after each of its bytes, begun at zero, from one scan.

    The stream is cut into lanes of ``SIDE`` bytes that advance together; the registers in front of the
    lanes are then carried over by doubling. Memory: about five bytes for each byte of the stream.
    """

    def __init__(self, stream: np.ndarray):
        lanes = -(-max(len(stream), 1) // SIDE)
        padded = np.zeros(lanes * SIDE, np.uint8)
        padded[:len(stream)] = stream
        table, columns = _byte_table(), np.ascontiguousarray(padded.reshape(lanes, SIDE).T)
        self._inside = np.empty((SIDE, lanes), np.uint32)
        register = np.zeros(lanes, np.uint32)
        for i in range(SIDE):
            register = table[(register ^ columns[i]) & 255] ^ (register >> 8)
            self._inside[i] = register
        carried, power = register.copy(), SIDE.bit_length() - 1
        while 1 << (power - SIDE.bit_length() + 1) < lanes:
            step = 1 << (power - SIDE.bit_length() + 1)
            carried[step:] ^= _apply(_shift_tables(power), carried[:-step])
            power += 1
        self._ahead = np.concatenate([np.zeros(1, np.uint32), carried])

    def after(self, n: np.ndarray) -> np.ndarray:
        """The registers after the first ``n`` bytes."""
        lane, i = np.divmod(np.maximum(n - 1, 0), SIDE)
        return np.where(n > 0, self._inside[i, lane] ^ shifted(self._ahead[lane], i + 1), np.uint32(0))

    def crc32(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of bytes ``first`` to ``end``: the prefix to ``first``, shifted by the length, cancels out."""
        begun = self.after(first) ^ INVERTED
        return self.after(end) ^ shifted(begun, end - first) ^ INVERTED
