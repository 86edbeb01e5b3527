"""LowMC as published: a block cipher over bits with few AND gates, for keyed images of join keys.

Each round substitutes some bit triples, multiplies by an invertible matrix over GF(2), and adds a constant
and a key of the round. Matrices and constants come from a seed, which all sides must share. Whole batches
are multiplied at once; no row sees another, so there is no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BITS = 128
MOST_ROUNDS = 20


def invertible(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A random invertible matrix over GF(2) and its inverse, by elimination."""
    while True:
        m = rng.integers(0, 2, (n, n), dtype=np.uint8)
        work, inverse = m.copy(), np.eye(n, dtype=np.uint8)
        for k in range(n):
            rows = np.flatnonzero(work[k:, k])
            if not len(rows):
                break
            for a in (work, inverse):
                a[[k, k + rows[0]]] = a[[k + rows[0], k]]
            others = work[:, k].astype(bool)
            others[k] = False
            work[others] ^= work[k]
            inverse[others] ^= inverse[k]
        else:
            return m, inverse


@dataclass(frozen=True)
class LowMC:
    """The cipher for one choice of parameters; bits are little-endian."""

    s_boxes: int = 10
    rounds: int = MOST_ROUNDS
    block: int = 128
    seed: int = 1
    linear: list[np.ndarray] = field(init=False, repr=False)
    inverse: list[np.ndarray] = field(init=False, repr=False)
    constants: np.ndarray = field(init=False, repr=False)
    key_matrices: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        if self.block not in (80, 128) or not 1 <= self.rounds <= MOST_ROUNDS or not 1 <= self.s_boxes <= self.block // 3:
            raise ValueError("block of 80 or 128 bits, 20 rounds at most, and no more S-boxes than the block has triples")
        rng = np.random.default_rng(self.seed)
        pairs = [invertible(rng, self.block) for _ in range(self.rounds)]
        made = {"linear": [m for m, _ in pairs], "inverse": [i for _, i in pairs], "constants": rng.integers(0, 2, (self.rounds, self.block), dtype=np.uint8), "key_matrices": rng.integers(0, 2, (self.rounds + 1, KEY_BITS, self.block), dtype=np.uint8)}
        for name, value in made.items():
            object.__setattr__(self, name, value)

    def round_keys(self, key: int) -> np.ndarray:
        bits = np.array([key >> i & 1 for i in range(KEY_BITS)], np.uint8)
        return bits @ self.key_matrices & 1

    def _substitute(self, x: np.ndarray, back: bool) -> None:
        """The published S-box on the first triples, or its inverse, in place."""
        t = x[:, : 3 * self.s_boxes].reshape(len(x), self.s_boxes, 3)
        a, b, c = (t[:, :, i].copy() for i in range(3))
        if back:
            t[:, :, 0], t[:, :, 1], t[:, :, 2] = a ^ b ^ (b & c), b ^ (a & c), a ^ b ^ c ^ (a & b)
        else:
            t[:, :, 0], t[:, :, 1], t[:, :, 2] = a ^ (b & c), a ^ b ^ (a & c), a ^ b ^ c ^ (a & b)
        x[:, : 3 * self.s_boxes] = t.reshape(len(x), -1)

    def encrypt_bits(self, x: np.ndarray, key: int) -> np.ndarray:
        """Rows of bits; shorter ones are filled up with zeros."""
        if x.shape[1] > self.block:
            raise ValueError(f"more than {self.block} bits")
        keys = self.round_keys(key)
        state = np.zeros((len(x), self.block), np.uint8)
        state[:, : x.shape[1]] = x
        state ^= keys[0]
        for r in range(self.rounds):
            self._substitute(state, False)
            state = (state.astype(np.float32) @ self.linear[r].T.astype(np.float32)).astype(np.uint8) & 1 ^ self.constants[r] ^ keys[r + 1]
        return state

    def decrypt_bits(self, state: np.ndarray, key: int) -> np.ndarray:
        keys = self.round_keys(key)
        for r in reversed(range(self.rounds)):
            state = (state ^ self.constants[r] ^ keys[r + 1]).astype(np.uint8) @ self.inverse[r].T & 1
            self._substitute(state, True)
        return state ^ keys[0]


def encrypt(df: DataFrame, column: str, key: int, name: str, cipher: LowMC | None = None) -> DataFrame:
    """df with the image of a BIGINT column (its 64 bits, filled up) as BINARY; NULL stays NULL."""
    cipher = cipher or LowMC()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            raw = values.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            image = np.packbits(cipher.encrypt_bits(np.unpackbits(raw, axis=1, bitorder="little"), key), axis=1, bitorder="little")
            out = pa.array([None if null else row.tobytes() for row, null in zip(image, values.is_null().to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn(column, F.col(column).cast("bigint")).mapInArrow(run, f"{schema}, `{name}` binary".replace(f"`{column}` {df.schema[column].dataType.simpleString()}", f"`{column}` bigint"))
