"""Instruction decoders: from bytes to candidate instructions at every offset.

A decoder takes the concatenated bytes of many images and where each image starts, and fills one record
per offset.  Addresses count from 1 within an image.  ``fall`` and ``jump`` are the known targets
(0: none; real targets of 0 or below are told by ``has_jump``).  ``defs`` and ``uses`` are bit sets of
registers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("ret", "jmp", "cond", "call", "invalid", "seq")
RET, JMP, COND, CALL, INVALID, SEQ = range(6)
REGISTERS = tuple(f"r{i}" for i in range(8))


@dataclass
class Decoded:
    image: np.ndarray  # which image of the batch
    addr: np.ndarray
    length: np.ndarray
    kind: np.ndarray
    has_fall: np.ndarray
    has_jump: np.ndarray
    jump: np.ndarray
    defs: np.ndarray
    uses: np.ndarray
    size: np.ndarray  # bytes in the image, by offset
    word: np.ndarray  # the address-wide word read at the offset; -1 where it is cut off

    @property
    def valid(self) -> np.ndarray:
        return self.kind != INVALID

    @property
    def fall(self) -> np.ndarray:
        return self.addr + self.length


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(first)
    image = np.repeat(np.arange(len(n)), n)
    return image, np.arange(first[-1]) - first[image] + 1, n[image]


def t8(data: bytes, first: np.ndarray) -> Decoded:
    """The synthetic instruction set T8: length, kind, displacement and registers are arithmetic on one byte."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    image, addr, size = _places(first)
    length = 1 + b % 4
    k = b // 4 % 8
    kind = np.array([RET, JMP, COND, CALL, INVALID, SEQ, SEQ, SEQ])[k]
    kind[addr + length - 1 > size] = INVALID
    bad = kind == INVALID
    length[bad] = 1
    has_jump = (kind == JMP) | (kind == COND) | (kind == CALL)
    has_fall = (kind == SEQ) | (kind == COND) | (kind == CALL)
    jump = addr + length + b * 37 % 41 - 20
    defs = np.where(bad, 0, 1 << b % 8)
    uses = np.where(bad, 0, 1 << b // 8 % 8)
    return Decoded(image, addr, length, kind, has_fall, has_jump, np.where(has_jump, jump, 0), defs, uses, size, b)


#: Fixed values of the x86 subset: opcode, kind, bytes in all, bytes of a relative target.
X86_OPCODES = {
    **{op: (SEQ, 1, 0) for op in (*range(0x50, 0x60), 0x90, 0xF8, 0xF9, 0xFC, 0xFD)},
    0x2D: (SEQ, 5, 0), 0x05: (SEQ, 5, 0), 0xC3: (RET, 1, 0), 0xE9: (JMP, 5, 4), 0xEB: (JMP, 2, 1), 0xE8: (CALL, 5, 4), **{op: (COND, 2, 1) for op in range(0x70, 0x80)},
}


def x86_subset(data: bytes, first: np.ndarray) -> Decoded:
    """A few 32-bit x86 instructions, enough for small hand-made images; everything else is undecodable."""
    image, addr, size = _places(first)
    n = len(addr)
    b = np.frombuffer(data + bytes(5), np.uint8).astype(np.int64)
    at = np.arange(n)
    op, left = b[:n], size - addr + 1
    kinds, totals, relatives = (np.array([X86_OPCODES.get(x, (INVALID, 1, 0))[k] for x in range(256)]) for k in range(3))
    kind, length, relative = kinds[op], totals[op], relatives[op]
    two = (op == 0xDD) & (left > 1) & (b[1 : n + 1] >= 0xC0) & (b[1 : n + 1] <= 0xC7)
    kind[two], length[two] = SEQ, 2
    cut_off = (kind == INVALID) | (length > left)
    kind[cut_off], length[cut_off], relative[cut_off] = INVALID, 1, 0
    has_jump = relative > 0
    long = (b[at + 1] | b[at + 2] << 8 | b[at + 3] << 16 | b[at + 4] << 24).astype(np.uint32).view(np.int32)
    short = b[at + 1].astype(np.uint8).view(np.int8)
    jump = np.where(has_jump, addr + length + np.where(relative == 4, long, short).astype(np.int64), 0)
    none = np.zeros(n, np.int64)
    word = np.where(left >= 4, b[at] | b[at + 1] << 8 | b[at + 2] << 16 | b[at + 3] << 24, -1)
    return Decoded(image, addr, length, kind, (kind == SEQ) | (kind == COND) | (kind == CALL), has_jump, jump, none, none, size, word)


ISAS = {"t8": t8, "x86": x86_subset}
