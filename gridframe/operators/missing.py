"""G5 as sets: which cells ever, always or sometimes lack data, as bitmaps.

Tasks OR the masks of their segments into bits, per layer (variable and level) and
stretch of 32,768 cells; ``bitmap_or_agg`` merges them and ``bitmap_count`` counts.
A record's mask is known by a fingerprint that does not depend on the order in
which its blocks come, so records that share a mask are counted without moving it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.session import ship_package

STRETCH = 32_768
#: stretches whose bits a task holds before it hands them on (two times 32 KiB each)
STRETCHES_IN_TASK = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gone(values: np.ndarray, fill: float) -> np.ndarray:
    f32 = np.float32(fill)
    return np.isnan(values) if np.isnan(f32) else values == f32


def _pieces(spans: list[tuple[int, int, int]], block: int, length: int, block_size: int):
    """(layer, first cell of the layer, first and last place in the block) of the layers in a block."""
    lo, hi = block * block_size, block * block_size + length
    for layer, offset, size in spans:
        a, b = max(lo, offset), min(hi, offset + size)
        if a < b:
            yield layer, a - offset, a - lo, b - lo


def _layer_bits(spans, block_size: int, fill: float):
    def flush(bits):
        keys = list(bits)
        packed = [[np.packbits(bits[k][s], bitorder="little").tobytes() for k in keys] for s in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(p, pa.binary()) for p in packed)],
            names=["layer", "stretch", "lacking", "present"])

    def run(batches):
        bits: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch.column("values")
            ends = np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False))
            gone = _gone(values.flatten().to_numpy(zero_copy_only=False), fill)
            at = 0
            for block, end in zip(batch.column("block_id").to_pylist(), ends.tolist()):
                for layer, cell, a, b in _pieces(spans, block, end - at, block_size):
                    while a < b:
                        stretch, place = divmod(cell, STRETCH)
                        n = min(b - a, STRETCH - place)
                        held = bits.setdefault((layer, stretch), np.zeros((2, STRETCH), bool))
                        part = gone[at + a:at + a + n]
                        held[0, place:place + n] |= part
                        held[1, place:place + n] |= ~part
                        a, cell = a + n, cell + n
                at = end
            if len(bits) > STRETCHES_IN_TASK:
                yield flush(bits)
                bits = {}
        if bits:
            yield flush(bits)

    return run


def _layer_prints(spans, block_size: int, fill: float):
    schema = pa.schema([("record_name", pa.string()), ("layer", pa.int32()), ("print", pa.int64()), ("lacking", pa.int64())])

    def run(batches):
        for batch in batches:
            values = batch.column("values")
            ends = np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False))
            gone = _gone(values.flatten().to_numpy(zero_copy_only=False), fill)
            rows, at = [], 0
            for name, block, end in zip(batch.column("record_name").to_pylist(), batch.column("block_id").to_pylist(), ends.tolist()):
                for layer, cell, a, b in _pieces(spans, block, end - at, block_size):
                    cells = cell + np.flatnonzero(gone[at + a:at + b])
                    mark = np.bitwise_xor.reduce(_mix(cells + 1)).view(np.int64) if len(cells) else np.int64(0)
                    rows.append((name, layer, int(mark), len(cells)))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def missing_patterns(segments: DataFrame, layout: DataFrame, block_size: int, fill: float) -> DataFrame:
    """Per layer: ``(var, level, n_cells, n_ever, n_always, n_sometimes, n_masks,
    n_shared)``: cells that some, all, and some but not all records lack; how many
    different masks the records have, and how many records share the commonest.

    What is shuffled is one pair of bitmaps per task and stretch, and one
    fingerprint per record and layer."""
    spark = segments.sparkSession
    ship_package(spark)
    rows = layout.select("var", "level", "offset", "length").orderBy("offset").collect()  # metadata: a row per layer
    spans = [(i, int(r["offset"]), int(r["length"])) for i, r in enumerate(rows)]
    layers = spark.createDataFrame([(i, r["var"], int(r["level"]), int(r["length"])) for i, r in enumerate(rows)],
                                   "layer int, var string, level int, n_cells long")
    seg = segments.select("record_name", "block_id", "values")
    bits = seg.mapInArrow(_layer_bits(spans, block_size, fill), "layer int, stretch long, lacking binary, present binary")
    both = bits.groupBy("layer", "stretch").agg(F.bitmap_or_agg("lacking").alias("lacking"), F.bitmap_or_agg("present").alias("present")).groupBy(
        "layer").agg(F.sum(F.bitmap_count("lacking")).alias("n_ever"), F.sum(F.bitmap_count("present")).alias("n_present"))
    prints = seg.mapInArrow(_layer_prints(spans, block_size, fill), "record_name string, layer int, print long, lacking long")
    masks = prints.groupBy("layer", "record_name").agg(F.bit_xor("print").alias("print"), F.sum("lacking").alias("lacking")).groupBy(
        "layer", "print", "lacking").agg(F.count("*").alias("n")).groupBy("layer").agg(F.count("*").alias("n_masks"), F.max("n").alias("n_shared"))
    always = F.col("n_cells") - F.col("n_present")
    return F.broadcast(layers).join(both, "layer").join(masks, "layer").select(
        "var", "level", "n_cells", "n_ever", always.alias("n_always"), (F.col("n_ever") - always).alias("n_sometimes"), "n_masks", "n_shared")
