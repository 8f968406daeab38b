"""Keccak-f[1600] over whole batches of short messages, and the selectors that contracts derive from it.

The 25 lanes of all messages of a batch are columns of one array, so each step of a round is one operation on the batch.
Offsets and round constants come from their definitions: a walk over the lanes and a shift register.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ROUNDS = 24


def round_constants() -> list[int]:
    """Bits 2^j - 1 of each round's constant come from the register x^8 + x^6 + x^5 + x^4 + 1."""
    out, state = [], 1
    for _ in range(ROUNDS):
        value = 0
        for j in range(7):
            value |= (state & 1) << ((1 << j) - 1)
            state <<= 1
            if state & 0x100:
                state ^= 0x171
        out.append(value)
    return out


def walk() -> list[tuple[int, int, int]]:
    """(from lane, to lane, turn) of the steps rho and pi together; lanes are x + 5 y."""
    out, x, y = [(0, 0, 0)], 1, 0
    for t in range(24):
        to = y, (2 * x + 3 * y) % 5
        out.append((x + 5 * y, to[0] + 5 * to[1], (t + 1) * (t + 2) // 2 % 64))
        x, y = to
    return out


CONSTANTS, WALK = round_constants(), walk()


def turned(a: np.ndarray, n: int) -> np.ndarray:
    return a << np.uint64(n) | a >> np.uint64(64 - n) if n else a


def permuted(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """Keccak-f[1600] of 25 lanes, each an array with one number a message."""
    for constant in CONSTANTS:
        column = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
        lanes = [lanes[k] ^ column[(k + 4) % 5] ^ turned(column[(k + 1) % 5], 1) for k in range(25)]
        moved = list(lanes)
        for a, b, n in WALK:
            moved[b] = turned(lanes[a], n)
        lanes = [moved[k] ^ (~moved[k // 5 * 5 + (k + 1) % 5] & moved[k // 5 * 5 + (k + 2) % 5]) for k in range(25)]
        lanes[0] = lanes[0] ^ np.uint64(constant)
    return lanes


def keccak(messages: list[bytes], rate: int = 136, size: int = 32) -> list[bytes]:
    """The digests of messages, padded as Keccak was before it became a standard (a single one bit after the message)."""
    out = [b""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for k, m in enumerate(messages):
        by_blocks.setdefault(len(m) // rate + 1, []).append(k)
    for blocks, places in by_blocks.items():
        padded = np.zeros((len(places), blocks * rate), np.uint8)
        for row, k in enumerate(places):
            padded[row, : len(messages[k])] = np.frombuffer(messages[k], np.uint8)
            padded[row, len(messages[k])] ^= 0x01
        padded[:, -1] ^= 0x80
        words = padded.view("<u8")
        lanes = [np.zeros(len(places), np.uint64) for _ in range(25)]
        for b in range(blocks):
            for k in range(rate // 8):
                lanes[k] = lanes[k] ^ words[:, b * (rate // 8) + k]
            lanes = permuted(lanes)
        digests = np.stack(lanes[: size // 8], axis=1).astype("<u8").view(np.uint8)
        for row, k in enumerate(places):
            out[k] = digests[row].tobytes()
    return out


@F.pandas_udf(StringType())
def _keccak_hex(texts: pd.Series) -> pd.Series:
    known = texts.notna()
    found = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    found[known] = [d.hex() for d in keccak([t.encode() for t in texts[known]])]
    return found


def keccak_256(text: Column) -> Column:
    """The Keccak-256 digest of a text in UTF-8, in lower-case hex; null of null."""
    return _keccak_hex(text)


def selector(signature: Column) -> Column:
    """0x and the first four bytes of the digest of a canonical signature, such as transfer(address,uint256)."""
    return F.concat(F.lit("0x"), F.substring(keccak_256(signature), 1, 8))
