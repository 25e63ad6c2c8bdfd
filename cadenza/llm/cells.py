"""Tables of a fixed number of cells, counted in tasks and summed block by block over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 16


def cut(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-zero cells of a table, in blocks: places and values as bytes."""
    for block in range(-(-len(table) // BLOCK)):
        own = table[block * BLOCK: (block + 1) * BLOCK]
        at = np.flatnonzero(own)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[at].astype(np.int32).tobytes()], pa.binary())],
                names=["block", "places", "counts"])


CUT = "block int, places binary, counts binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one partition, streaming: one array per block is held."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, places, counts in zip(batch["block"].to_pylist(), batch["places"], batch["counts"]):
            own = total.setdefault(block, np.zeros(BLOCK, dtype=np.int32))
            own[np.frombuffer(places.as_buffer(), dtype=np.uint16)] += np.frombuffer(counts.as_buffer(), dtype=np.int32)
    for block, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())],
            names=["block", "places", "counts"])


def merged(blocks: DataFrame, cells: int) -> np.ndarray:
    """The merged table, of a fixed number of cells: the rows collected are at most cells / BLOCK."""
    out = np.zeros(cells, dtype=np.int32)
    for block, places, counts in blocks.select("block", "places", "counts").repartition("block").mapInArrow(_merge, CUT).collect():
        out[block * BLOCK + np.frombuffer(places, dtype=np.uint16).astype(np.int64)] = np.frombuffer(counts, dtype=np.int32)
    return out


def repeated_bits(blocks: DataFrame, cells: int) -> np.ndarray:
    """Packed bits of the cells whose total is at least two; cells / 8 bytes whatever the counts."""
    out = np.zeros(cells // 8, dtype=np.uint8)
    summed = blocks.select("block", "places", "counts").repartition("block").mapInArrow(_merge, CUT).mapInArrow(_packed, "block int, bits binary")
    for block, bits in summed.collect():
        out[block * BLOCK // 8: (block + 1) * BLOCK // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for places, counts in zip(batch["places"], batch["counts"]):
            own = np.zeros(BLOCK, dtype=bool)
            own[np.frombuffer(places.as_buffer(), dtype=np.uint16)] = np.frombuffer(counts.as_buffer(), dtype=np.int32) > 1
            bits.append(np.packbits(own).tobytes())
        yield pa.RecordBatch.from_arrays([batch["block"], pa.array(bits, pa.binary())], names=["block", "bits"])


def has_bits(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0
