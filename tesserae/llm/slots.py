"""Counts of 64-bit keys in slots, for bits that say of any key how often its slot occurs: of bounded size, however many keys there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slots at most, as a power of two, slots of a part that is summed up apart, and keys that are counted together before they are sent.
MOST, SIZE, AT_ONCE = 27, 1 << 16, 1 << 20


def power_for(keys: int, each: int, most: int = MOST) -> int:
    """The power of two of slots for so many keys, each slots for a key: small tables have small bit sets, which go through the driver; none has more than most."""
    return max(16, min(most, (keys * each - 1).bit_length()))


def slot_of(keys: np.ndarray, power: int) -> np.ndarray:
    """By a product's high bits: keys that are all small are spread over all slots too."""
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - power)).astype(np.uint32)


def bit_of(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = slot_of(keys, (8 * len(bits)).bit_length() - 1)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _steps(slots: np.ndarray) -> bytes:
    """Ascending slots as their steps: all low bytes, then all high bytes, which are mostly zero and shrink when they are sent."""
    d = np.diff(slots, prepend=0)
    return (d & 255).astype(np.uint8).tobytes() + (d >> 8).astype(np.uint8).tobytes()


def _from_steps(blob: pa.Buffer) -> np.ndarray:
    low, high = np.frombuffer(blob, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(low | high << 8)


def _counts(arrays: Callable[[pa.RecordBatch], Iterator[np.ndarray]], power: int):
    parts = (1 << power) // SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(slots, np.arange(parts + 1, dtype=np.int64) * SIZE)
            full = [i for i in range(parts) if cut[i] < cut[i + 1]]
            blob = lambda f: pa.array([f(slice(cut[i], cut[i + 1])) for i in full], pa.binary())
            # 255 of one sending stand for all above: no rule asks for so many.
            few = np.minimum(counts, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), blob(lambda x: _steps(slots[x] % SIZE)), blob(lambda x: few[x].tobytes())], ["part", "slots", "counts"])

        for b in batches:
            for keys in arrays(b):
                held.append(slot_of(keys, power))
                n += len(keys)
                if n >= AT_ONCE:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    return run


def _marked(rule: Callable[[np.ndarray], np.ndarray]):
    """Sums up one part after another: its rows stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = -1, np.zeros(SIZE, np.uint32)
        found = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(rule(own)).tobytes()], pa.binary())], ["part", "bits"])
        for b in batches:
            for part, slots, n in zip(b.column("part").to_pylist(), b.column("slots"), b.column("counts"), strict=True):
                if part != held:
                    if held >= 0:
                        yield found()
                    held = part
                    own[:] = 0
                own[_from_steps(slots.as_buffer())] += np.frombuffer(n.as_buffer(), np.uint8)
        if held >= 0:
            yield found()

    return run


def slot_bits(rows: DataFrame, arrays: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rule: Callable[[np.ndarray], np.ndarray], power: int = MOST) -> np.ndarray:
    """A bit for each of 2 ** power slots, as rule says of the counts of a part's slots. arrays gives the keys (uint64) of a batch of rows; all rows count. 16 MB come to the driver at most."""
    counted = rows.mapInArrow(_counts(arrays, power), "part int, slots binary, counts binary")
    out = np.zeros(((1 << power) // SIZE, SIZE // 8), np.uint8)
    for r in counted.repartition("part").sortWithinPartitions("part").mapInArrow(_marked(rule), "part int, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)
