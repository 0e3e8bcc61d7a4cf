"""WAV files, CSV rows, transcripts and the Markdown report."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def encode_wav(audio: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """16-bit PCM of interleaved samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.rint(np.asarray(audio, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def write_wavs(rows: DataFrame, folder: str, rate: int, name: str = "script_id") -> None:
    """One file for each row, in a folder that all executors see; a file is there whole or not at all."""
    folder = folder.removeprefix("file://")
    columns = [name, "audio", *(["channels"] if "channels" in rows.columns else [])]

    def write(part: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in part:
            path = os.path.join(folder, f"{row[name]}.wav")
            with open(f"{path}.part", "wb") as f:
                f.write(encode_wav(row["audio"], rate, row["channels"] if "channels" in columns else 1))
            os.replace(f"{path}.part", path)

    rows.select(*columns).foreachPartition(write)


def write_files(rows: DataFrame, folder: str) -> None:
    """(name, content) as files of these names, in a folder that all executors see."""
    folder = folder.removeprefix("file://")

    def write(part: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in part:
            path = os.path.join(folder, row["name"])
            with open(f"{path}.part", "wb") as f:
                f.write(row["content"])
            os.replace(f"{path}.part", path)

    rows.select("name", "content").foreachPartition(write)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    """A checkpoint after each batch of records."""
    rows.write.mode("append").json(path)


def write_transcripts(rows: DataFrame, path: str, name: str = "wav") -> None:
    rows.select(F.col(name), F.col("transcript").alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines) + "\n"
