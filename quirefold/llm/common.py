"""Helpers shared by the training-text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator, over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x + MIX_A).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * MIX_B
        x = (x ^ (x >> np.uint64(27))) * MIX_C
        return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a (staged) table has at most ``rows`` rows, counted on the executors."""
    return df.count() <= rows


def arrow_rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def script(ch: str) -> str:
    """One letter for the script of a character: Latin, Greek, Cyrillic, Arabic,
    Devanagari, Thai, Kana, Han; O for everything else."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFF21 <= o < 0xFF5B:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x590 <= o < 0x780 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFEFF:
        return "A"
    if 0x900 <= o < 0x980:
        return "D"
    if 0xE00 <= o < 0xE80:
        return "T"
    if 0x3040 <= o < 0x3100 or 0xFF66 <= o < 0xFF9E:
        return "K"
    if 0x2E80 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or o >= 0x20000:
        return "H"
    return "O"
