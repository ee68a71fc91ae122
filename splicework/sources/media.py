"""Media as rows: colour tables (.cube) and 16-bit PCM sound (WAV), read and written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_ROW = rf"^[\x20\x09]*({_NUMBER})[\x20\x09]+({_NUMBER})[\x20\x09]+({_NUMBER})[\x20\x09\r]*$"
#: Frames a block of samples has.
BLOCK = 48_000


def parse_cube(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per colour of .cube texts with a three-dimensional table: id, size, index (red runs fastest), r, g, b.

    Texts without LUT_3D_SIZE, or with another number of colours than it says, have none."""
    size = F.try_to_number(F.regexp_extract(text_col, r"(?m)^LUT_3D_SIZE[\x20\x09]+([0-9]{1,3})[\x20\x09\r]*$", 1), F.lit("999")).cast("int")
    own = files.select(id_col, size.alias("size"), F.filter(F.split(text_col, "\n"), lambda x: x.rlike(_ROW)).alias("_rows"))
    own = own.where((F.col("size") >= 2) & (F.size("_rows") == F.col("size") * F.col("size") * F.col("size")))
    own = own.select(id_col, "size", F.posexplode("_rows").alias("index", "_row"))
    return own.select(id_col, "size", F.col("index").cast("long").alias("index"), *(F.regexp_extract("_row", _ROW, k).cast("double").alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))))


def _chunks(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    view, at = memoryview(content), 12
    while at + 8 <= len(view):
        size = struct.unpack_from("<I", view, at + 4)[0]
        yield bytes(view[at : at + 4]), view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def sound_blocks(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """16-bit PCM of WAV files in blocks: id, rate, channel (from 0), first (frame), values. Other content gives no rows.

    A file is read as one row; a block has BLOCK frames at most."""
    id_type = files.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch[id_col], batch[content_col], strict=True):
                if content is None or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
                    continue
                parts = dict(reversed(list(_chunks(content))))  # the first of a kind counts
                if len(parts.get(b"fmt ", b"")) < 16 or b"data" not in parts:
                    continue
                kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
                if kind not in (1, 0xFFFE) or bits != 16 or not channels:
                    continue
                data = parts[b"data"]
                frames = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
                for at in range(0, len(frames), BLOCK):
                    yield pd.DataFrame({id_col: name, "rate": rate, "channel": range(channels), "first": at, "values": list(frames[at : at + BLOCK].T.astype(np.int32))})

    return files.select(id_col, content_col).mapInPandas(rows, f"{id_col} {id_type}, rate long, channel int, first long, `values` array<int>")


def sound_samples(blocks: DataFrame, id_col: str) -> DataFrame:
    """A row per sample: id, rate, channel, frame, value."""
    own = blocks.select(id_col, "rate", "channel", "first", F.posexplode("values").alias("_i", "value"))
    return own.select(id_col, "rate", "channel", (F.col("first") + F.col("_i")).alias("frame"), F.col("value").cast("long").alias("value"))


def encode_wav(samples: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """A WAV file per key from samples (keys, channel, frame, value): keys, content. Values are held within 16 bits; absent ones are 0.

    A file is one row, so it is made in one task."""
    types = "".join(f"{k} {samples.schema[k].dataType.simpleString()}, " for k in keys)

    def file(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, frames = int(pdf["channel"].max()) + 1, int(pdf["frame"].max()) + 1
        data = np.zeros((frames, channels), "<i2")
        data[pdf["frame"].to_numpy(), pdf["channel"].to_numpy()] = pdf["value"].clip(-32_768, 32_767)
        body = data.tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "content": [head + body]})

    return samples.select(*keys, "channel", "frame", "value").groupBy(*keys).applyInPandas(file, f"{types}content binary")
