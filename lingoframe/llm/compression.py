"""Compression bands: zstandard ratios of whole documents and of fixed chunks, with limits by length.

Text that compresses far better than prose of its length repeats itself; text that hardly compresses is noise. What prose
compresses to depends on its length, since short inputs carry the frame and hold fewer repeats, so the limits do too.
They stand at about half and at one and a half times what zstandard makes of prose of that length in alphabetic scripts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lingoframe.llm.shared import map_texts

LEVEL = 3
CHUNK = 4096
#: (bytes from, lowest ratio, highest ratio) for whole documents; below the first nothing is judged.
BANDS = ((64, 0.40, 1.60), (128, 0.35, 1.10), (256, 0.30, 0.90), (1024, 0.24, 0.72), (4096, 0.20, 0.68), (16384, 0.18, 0.62))
#: Limits of a chunk, and the share of a document's chunks that may lie outside them.
CHUNK_BAND = (0.20, 0.72)
BAD_CHUNKS = 0.25

#: Columns that the operator adds.
MADE = ("n_bytes", "ratio", "chunks", "bad_chunks", "reason", "keep")


def limits(n_bytes: int, bands=BANDS) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands:
        if n_bytes >= least:
            found = low, high
    return found


def judged(text: str, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK, bands=BANDS, chunk_band=CHUNK_BAND, bad_share: float = BAD_CHUNKS) -> tuple[int, float | None, int, int, str]:
    """Bytes, ratio, whole chunks (of texts of two at least), those outside the limits, and why the text goes ('' if it stays).

    The verdict also takes the chunk of a shorter text, and what is left over at the end: as a last chunk of full length
    that overlaps the one before it, so that the same limits hold."""
    data = text.encode("utf-8", "replace")
    if not data:
        return 0, None, 0, 0, "empty"
    ratio = len(compressor.compress(data)) / len(data)
    n = bad_low = bad_high = 0
    whole, bad_whole = len(data) // chunk if len(data) >= 2 * chunk else 0, 0
    if len(data) >= chunk:
        for at in [*range(0, len(data) - chunk + 1, chunk), *([len(data) - chunk] if len(data) % chunk else [])]:
            r = len(compressor.compress(data[at : at + chunk])) / chunk
            n, bad_low, bad_high = n + 1, bad_low + (r < chunk_band[0]), bad_high + (r > chunk_band[1])
            if n == whole:
                bad_whole = bad_low + bad_high
    band = limits(len(data), bands)
    why = ""
    if band and ratio < band[0]:
        why = "repetitive"
    elif band and ratio > band[1]:
        why = "incompressible"
    elif bad_low > bad_share * n:
        why = "repetitive chunks"
    elif bad_low + bad_high > bad_share * n:
        why = "incompressible chunks"
    return len(data), ratio, whole, bad_whole, why


def compression_bands(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, **parameters) -> DataFrame:
    """Add n_bytes, ratio, chunks, bad_chunks, reason and keep (boolean) to every row.

    Null and empty texts are not kept (reason 'empty', null ratio). Texts under the first band are kept unless empty. A
    text of one chunk or more is also judged by its chunks and by its last CHUNK bytes; the columns chunks and bad_chunks
    count the whole chunks of texts of two or more. Texts of any length are compressed whole. Repeated rows are judged alike; an empty table gives an empty table; other columns
    pass, and those named as the new ones are replaced. Nothing is shuffled.
    """

    def make():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def apply(texts: list[str | None]) -> list:
            rows = [judged(t or "", compressor, **parameters) for t in texts]
            n, ratio, chunks, bad, why = zip(*rows)
            return [n, ratio, chunks, bad, why, np.array([not w for w in why], bool)]

        return apply

    fields = [
        ("n_bytes", T.LongType(), pa.int64()),
        ("ratio", T.DoubleType(), pa.float64()),
        ("chunks", T.IntegerType(), pa.int32()),
        ("bad_chunks", T.IntegerType(), pa.int32()),
        ("reason", T.StringType(), pa.string()),
        ("keep", T.BooleanType(), pa.bool_()),
    ]
    return map_texts(df, text_col, fields, make, keep)
