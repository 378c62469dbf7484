"""Heatmap tiles: what a picture of a map is drawn from."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.stores import file_system


def reduction(max_dim: int, max_image: int | None = 4000) -> int:
    """Cells per pixel, so that no side exceeds ``max_image``."""
    return -(-max_dim // max_image) if max_image and max_dim > max_image else 1


def downsample(matrix: DataFrame, block: int, method: str = "mean", size: int | None = None) -> DataFrame:
    """Blocks of cells: mean (absent cells are 0, also beyond the edge) or max (0 at least where a block has absent cells)."""
    key = [F.floor(F.col("i") / block).cast("int").alias("i"), F.floor(F.col("j") / block).cast("int").alias("j")]
    if method == "mean":
        return matrix.groupBy(*key).agg((F.sum("w") / float(block * block)).alias("w"))
    if method != "max":
        raise RuntimeError(f"{method} is no known method: mean or max is")
    full = F.when(F.count("*") == block * block, F.max("w")).otherwise(F.greatest(F.max("w"), F.lit(0)))
    return matrix.groupBy(*key).agg(full.alias("w"))


def log_tiles(matrix: DataFrame, alpha: float = 0.01, zero_diagonal: bool = True, times: float = 100.0) -> DataFrame:
    """ln(w x times + alpha) of the cells that are there; an absent cell is ln(alpha)."""
    w = F.when(F.lit(zero_diagonal) & (F.col("i") == F.col("j")), F.lit(0.0)).otherwise(F.col("w") * times)
    return matrix.select("i", "j", F.ln(w + alpha).alias("w"))


def pattern(matrix: DataFrame) -> DataFrame:
    return matrix.where("w <> 0").select("i", "j")


def cluster_ticks(clusters: DataFrame, sizes: str = "size", ends: bool = False) -> DataFrame:
    """(tick, label): where each cluster begins, and the end of the last; doubled for maps of ends."""
    unit = 2 if ends else 1
    run = Window.orderBy("cl_id").rowsBetween(Window.unboundedPreceding, 0)
    after = clusters.select((F.sum(sizes).over(run) * unit).alias("tick"), F.lead("name").over(Window.orderBy("cl_id")).alias("label"))
    first = clusters.orderBy("cl_id").limit(1).select(F.lit(0).cast("bigint").alias("tick"), F.col("name").alias("label"))
    return first.unionByName(after.select(F.col("tick").cast("bigint").alias("tick"), "label"))


def contig_labels(ordering: DataFrame, contigs: DataFrame, ends: bool = False) -> DataFrame:
    """(tick, label): ``+ name`` or ``- name`` along the axis."""
    sign = F.when(F.col("ori") < 0, F.lit("- ")).otherwise(F.lit("+ "))
    return ordering.join(contigs.select("ix", "name"), "ix").select((F.col("rank") * (2 if ends else 1)).alias("tick"), F.concat(sign, F.col("name")).alias("label"))


def write_png(tiles: DataFrame, side: int, path: str, alpha: float = 0.01, robust: bool = True) -> None:
    """A picture of log tiles (i, j, w), a cell per pixel, dark where contacts are many; absent cells are ln(alpha).

    The driver holds the picture: ``side`` is what ``reduction`` left, at most the largest image asked for.  ``robust`` stretches the greys between
    the 2nd and the 98th percentile of the cells.
    """
    cells = tiles.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("w").cast("double").alias("w")).toArrow()
    floor = float(np.log(alpha))
    image = np.full((side, side), floor, np.float32)
    image[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("w").to_numpy()
    low, high = np.percentile(image, (2, 98)) if robust else (image.min(), image.max())
    if high <= low:
        low, high = image.min(), max(image.max(), image.min() + 1)
    grey = 255 - np.clip((image - low) * (255 / (high - low)), 0, 255).astype(np.uint8)
    raw = np.zeros((side, side + 1), np.uint8)  # each row is led by the filter's number, 0
    raw[:, 1:] = grey

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    system, own = file_system(path)
    with system.open_output_stream(own, compression=None) as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b""))
