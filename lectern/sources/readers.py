"""Scripts, inputs, reports, clips and probe tables as DataFrames."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.segment import parse_script

#: (carrier sentence, raw term, respelling, pattern that shows it was recognised)
PROBES = [
    ("It runs on {}.", "nginx", "engine ex", r"\bnginx\b|engine\s*ex"),
    ("Open {} now.", "Xcode", "ex code", r"\bx\s*code\b|ex\s*code"),
    ("We use {} here.", "SQLite", "sequel light", r"\bsqlite\b|sequel\s*lite?|sequel\s*light"),
    ("The key is sent over {} only.", "TLS", "tee ell ess", r"\bt\s*l\s*s\b|tee\s*ell"),
    ("Her talk on {} filled the hall.", "GNU", "guh noo", r"\bgnu\b|guh?\s*noo"),
    ("Send the form as a {} file.", "PDF", "pee dee eff", r"\bp\s*d\s*f\b|pee\s*dee"),
    ("The letters were signed by {}.", "Siobhan", "shiv awn", r"\bsiobhan\b|shiv\s*awn|\bchevonne\b"),
    ("They met again in {} that year.", "Leicester", "lester", r"\bleicester\b|\blest(?:er|a)\b"),
    ("Their {} went into the archive.", "JPEG", "jay peg", r"\bjpeg\b|jay\s*peg"),
]
#: (id, language, category, expected contour, text): questions and statements whose end should rise or fall.
CASES = [
    ("cs_yn_1", "cs", "cs_yesno", "rise", "Vezmeš s sebou ten deštník?"),
    ("cs_yn_2", "cs", "cs_yesno", "rise", "Už jste tam byli letos v zimě?"),
    ("cs_yn_3", "cs", "cs_yesno", "rise", "Slyšíš mě dobře i odtud?"),
    ("cs_yn_4", "cs", "cs_yesno", "rise", "Napsala ti babička z lázní?"),
    ("cs_yn_5", "cs", "cs_yesno", "rise", "Chceš čaj?"),
    ("cs_wh_1", "cs", "cs_wh", "fall", "Kde necháváte přes noc kolo?"),
    ("cs_wh_2", "cs", "cs_wh", "fall", "Kdo otevřel v noci okno?"),
    ("cs_wh_3", "cs", "cs_wh", "fall", "Proč ten vlak zase stojí?"),
    ("cs_wh_4", "cs", "cs_wh", "fall", "Kolik stojí lístek do Brna?"),
    ("cs_decl_1", "cs", "cs_decl", "fall", "Vezmeš s sebou ten deštník."),
    ("cs_decl_2", "cs", "cs_decl", "fall", "Napsala ti babička z lázní."),
    ("cs_decl_3", "cs", "cs_decl", "fall", "Letos v zimě jsme tam byli."),
    ("en_yn_1", "en", "en_yesno", "rise", "Is the bakery still open?"),
    ("en_yn_2", "en", "en_yesno", "rise", "Will you carry the lamp upstairs?"),
    ("en_wh_1", "en", "en_wh", "fall", "Where do they keep the spare keys?"),
    ("en_wh_2", "en", "en_wh", "fall", "Who painted the gate green?"),
    ("en_decl_1", "en", "en_decl", "fall", "The bakery is still open."),
    ("mix_yn_1", "cs", "mix_yesno", "rise", "Pošleš mi ten screenshot ještě dnes?"),
    ("mix_yn_2", "cs", "mix_yesno", "rise", "Funguje ti ten backup server?"),
    ("mix_wh_1", "cs", "mix_wh", "fall", "Kdy skončí ten sprint review?"),
    ("mix_decl_1", "cs", "mix_decl", "fall", "Ten backup server mi funguje."),
]


def script_texts(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("script_id"), F.col("value").alias("text"))


def scripts(spark: SparkSession, path: str, gap_s: float = 1.0) -> DataFrame:
    """Segments of script files."""
    return parse_script(script_texts(spark, path), gap_s)


def segments(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Segments given in memory: (script_id, seg_no, kind, text, gap_s, voice_id)."""
    return spark.createDataFrame(rows, "script_id string, seg_no int, kind string, text string, gap_s double, voice_id string")


def spoken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): what is spoken of scripts with headings and pauses."""
    rows = script_texts(spark, path).select(F.col("script_id").alias("file"), F.transform(F.split("text", r"\r?\n"), T.stripped).alias("l"))
    return rows.select("file", F.array_join(F.filter("l", lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("[PAUSE")), " ").alias("text"))


def inputs(spark: SparkSession, folder: str, prefix: str | None = None, max_chars: int | None = None) -> tuple[DataFrame, int]:
    """((input_file, text, lang), how many were too long) of the text files of a folder."""
    rows = spark.read.option("pathGlobFilter", f"{prefix or ''}*.txt").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_name").alias("input_file"), T.stripped(F.col("value")).alias("text"))
    rows = rows.withColumn("lang", T.language_for(F.col("input_file")))
    if max_chars is None:
        return rows, 0
    return rows.where(F.length("text") <= max_chars), rows.where(F.length("text") > max_chars).count()


def report_rows(spark: SparkSession, path: str, limit: int | None = None, extra: str = "", lines: bool = False) -> DataFrame:
    """Results of JSON reports; with a limit the first that failed with a transcript.  extra: more fields of a result, as name and type; lines: a report on each line of the files, not one over a whole file."""
    more = "".join(f", {f.strip().replace(' ', ':', 1)}" for f in extra.split(",") if f.strip())
    schema = f"results array<struct<i:int, text:string, ok:boolean, coverage:double, transcript:string{more}>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("results").alias("r")).select("r.*")
    return rows if limit is None else rows.where("not ok and transcript <> ''").orderBy("i").limit(limit)


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, digest, transcript): reference clips with the text beside them."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")
    sound = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select(stem(F.col("path")).alias("stem"), "path", F.sha2("content", 256).alias("digest"))
    said = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("stem"), T.stripped(F.col("value")).alias("transcript"))
    return sound.join(said, "stem", "left")


def probes(spark: SparkSession, rows: list[tuple] = PROBES) -> DataFrame:
    return spark.createDataFrame(rows, "carrier string, raw string, respelling string, pattern string")


def cases(spark: SparkSession, rows: list[tuple] = CASES) -> DataFrame:
    return spark.createDataFrame(rows, "id string, lang string, category string, expected string, text string")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples) of 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        return f.getframerate(), (x.astype(np.float32) / 32768).mean(axis=1)


def wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, audio); both null where a file is no WAV."""

    def read(parts):
        for part in parts:
            rows = []
            for p, data in zip(part["path"], part["content"], strict=True):
                try:
                    rate, x = decode_wav(data)
                except (wave.Error, EOFError, ValueError, struct.error):
                    rate, x = None, None
                rows.append((p, rate, x))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "audio"]).astype({"sample_rate": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, sample_rate int, audio array<float>")
