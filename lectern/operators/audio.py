"""Waveforms as float arrays: trimming, fades, gain, limiting, contours, mastering.

Sample-wise steps are native; what slides frames over samples or filters is NumPy
in vectorised UDFs.  Loudness follows the public recommendation BS.1770.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .config import MasterConfig

FRAME_S, HOP_S, GUARD_S, FLOOR_DB, FADE_S = 0.030, 0.010, 0.030, -42.0, 0.008
LIMIT_KNEE = 0.8
TAIL, HEAD, LEAST_FRAMES = 30, 50, 60


def db(gain: float) -> float:
    return 10.0 ** (gain / 20.0)


def on_samples(step: Callable[[np.ndarray], np.ndarray]):
    """A UDF over float arrays."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(audio: pd.Series) -> pd.Series:
        return audio.map(lambda x: step(np.asarray(x, np.float32)).astype(np.float32), na_action="ignore")

    return run


def levels(x: np.ndarray, rate: int) -> np.ndarray:
    """Root mean square of each frame."""
    size, hop = max(1, int(FRAME_S * rate)), max(1, int(HOP_S * rate))
    if len(x) < size:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), size)[::hop]
    return np.sqrt((frames**2).mean(axis=1))


def trimmed(x: np.ndarray, rate: int) -> np.ndarray:
    """Without silence at the ends, but for a guard; short and silent audio as it is."""
    rms = levels(x, rate)
    if len(rms) < 2 or rms.max() <= 0:
        return x
    loud = np.flatnonzero(rms >= rms.max() * db(FLOOR_DB))
    size, hop, guard = int(FRAME_S * rate), int(HOP_S * rate), int(GUARD_S * rate)
    return x[max(0, loud[0] * hop - guard) : min(len(x), loud[-1] * hop + size + guard)]


def trim(audio: Column, rate: int) -> Column:
    return on_samples(lambda x: trimmed(x, rate))(audio)


def declick(audio: Column, rate: int) -> Column:
    """Linear fades at both ends; audio shorter than both stays."""
    n = int(FADE_S * rate)
    if n < 1:
        return audio
    size, last = F.size(audio), float(max(1, n - 1))
    edge = lambda i: F.when(i < n, i / F.lit(last)).when(i >= size - n, (size - 1 - i) / F.lit(last)).otherwise(F.lit(1.0))
    return F.when(size <= 2 * n, audio).otherwise(F.transform(audio, lambda x, i: (x * edge(i)).cast("float")))


def gained(audio: Column, gain_db: Column) -> Column:
    return F.when(F.coalesce(gain_db, F.lit(0.0)) == 0, audio).otherwise(F.transform(audio, lambda x: (x * F.pow(F.lit(10.0), gain_db / 20)).cast("float")))


def limited(audio: Column, ceiling: float) -> Column:
    """As it is below the knee, bent by tanh above it, always below the ceiling."""
    knee = LIMIT_KNEE * ceiling
    room = ceiling - knee
    # tanh reaches 1 for large values: the last float below the ceiling is the most
    most = float(np.float32(ceiling)) if float(np.float32(ceiling)) < ceiling else float(np.nextafter(np.float32(ceiling), np.float32(0)))
    soft = lambda x: F.signum(x) * F.least(F.lit(knee) + F.lit(room) * F.tanh((F.abs(x) - knee) / room), F.lit(most))
    return F.transform(audio, lambda x: F.when(F.abs(x) <= knee, x).otherwise(soft(x).cast("float")))


def silence(seconds: Column, rate: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), (seconds * rate).cast("int"))


def joined(rows: DataFrame, keys: list[str], order: str, audio: str = "audio") -> DataFrame:
    """The audio of each group in order, butt-joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(audio).alias("a"))))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["a"])).alias(audio))


def chunk_chain(rows: DataFrame, gain_db: Column, rate: int) -> DataFrame:
    """Trim, fade, gain of the column audio, as every chunk goes through.

    The trimmed audio is a column first: native lambdas can't be over a UDF's result.
    """
    return rows.withColumn("audio", trim(F.col("audio"), rate)).withColumn("audio", gained(declick(F.col("audio"), rate), gain_db))


def sine(duration: Column, level: Column, rate: int, stamp: Column) -> Column:
    """The simulated engine's wave; its first sample says which call it was."""
    n = F.greatest(F.floor(duration * rate).cast("int"), F.lit(2))
    wave = lambda k: (level * F.sin(F.lit(2 * math.pi * 220.0 / rate) * k)).cast("float")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, ((stamp + 1) * F.lit(1e-4)).cast("float")).otherwise(wave(k)))


def resampled(x: np.ndarray, rate: int, to: int = 16_000, zeros: int = 16) -> np.ndarray:
    """At another rate, by a windowed sinc of its own phase for each output sample."""
    if rate == to or not len(x):
        return x
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    cutoff = min(1.0, up / down)
    half = int(math.ceil(zeros / cutoff))
    out = np.arange(-(-len(x) * up // down))
    at = out * down / up
    base = np.floor(at).astype(np.int64)
    padded = np.pad(x.astype(np.float64), (half, half + 1))
    total = np.zeros(len(out))
    for k in range(-half + 1, half + 1):
        gap = at - (base + k)
        total += padded[base + k + half] * cutoff * np.sinc(cutoff * gap) * np.where(np.abs(gap) < half, 0.5 + 0.5 * np.cos(np.pi * gap / half), 0)
    return total


def resample(audio: Column, rate: int, to: int = 16_000) -> Column:
    return on_samples(lambda x: resampled(x, rate, to))(audio)


# contours ------------------------------------------------------------------


def pitch(x: np.ndarray, rate: int, low: float = 60.0, high: float = 450.0, threshold: float = 0.15) -> np.ndarray:
    """Fundamental frequency of the voiced frames, by the cumulative mean difference (YIN)."""
    size, hop = int(0.085 * rate), max(1, int(HOP_S * rate))
    most, least = int(rate / low), max(2, int(rate / high))
    if len(x) < size + most:
        return np.zeros(0)
    found = []
    x = x.astype(np.float64)
    for at in range(0, len(x) - size - most, hop):
        frame = x[at : at + size + most]
        if np.abs(frame).max() < 1e-4:
            continue
        n = 1 << (2 * len(frame) - 1).bit_length()
        spectrum = np.fft.rfft(frame[:size], n).conj() * np.fft.rfft(frame, n)
        product = np.fft.irfft(spectrum, n)[: most + 1]
        square = np.append(0, np.cumsum(frame**2))
        energy = square[size : size + most + 1] - square[: most + 1]
        differ = np.maximum(energy[0] + energy - 2 * product, 0)
        mean = differ[1:] * np.arange(1, most + 1) / np.maximum(np.cumsum(differ[1:]), 1e-12)
        good = np.flatnonzero(mean[least - 1 :] < threshold)
        if not len(good):
            continue
        k = good[0] + least - 1
        while k + 1 < len(mean) and mean[k + 1] < mean[k]:
            k += 1
        shift = 0.0
        if 0 < k < len(mean) - 1 and (bend := mean[k - 1] - 2 * mean[k] + mean[k + 1]) > 0:
            shift = 0.5 * (mean[k - 1] - mean[k + 1]) / bend
        found.append(rate / (k + 1 + shift))
    f0 = np.array(found)
    return f0[np.abs(12 * np.log2(f0 / np.median(f0))) <= 8] if len(f0) else f0


def voiced_f0(audio: Column, rate: int) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda x: pitch(trimmed(np.asarray(x, np.float32), rate), rate), na_action="ignore")

    return run(audio)


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def delta_from_f0(f0: Column) -> Column:
    """Semitones from the frames before the tail to the tail; null for too few frames."""
    n = F.size(f0)
    tail = F.slice(f0, n - TAIL + 1, F.lit(TAIL))
    begin = F.greatest(n - TAIL - HEAD, F.lit(0))
    head = F.slice(f0, begin + 1, n - TAIL - begin)
    return F.when(n >= LEAST_FRAMES, F.lit(12.0) * F.log2(_median(tail) / _median(head)))


def terminal_delta(audio: Column, rate: int) -> Column:
    """As of the audio; null wherever it can't be had."""

    @F.pandas_udf(DoubleType())
    def run(series: pd.Series) -> pd.Series:
        def one(x):
            try:
                f0 = pitch(trimmed(np.asarray(x, np.float32), rate), rate)
                if len(f0) < LEAST_FRAMES:
                    return None
                return float(12 * np.log2(np.median(f0[-TAIL:]) / np.median(f0[-TAIL - HEAD : -TAIL])))
            except Exception:
                return None

        return series.map(one, na_action="ignore").astype("float64")

    return run(audio)


def contour(delta: Column, threshold: float = 1.5) -> Column:
    return F.when(delta.isNull(), "undef").when(delta >= threshold, "rise").when(delta <= -threshold, "fall").otherwise("flat")


def with_contour(rows: DataFrame, rate: int, audio: str = "audio") -> DataFrame:
    """rows with delta_st, voiced_frames and contour of a waveform."""
    found = rows.withColumn("f0", F.coalesce(voiced_f0(F.col(audio), rate), F.array().cast("array<double>")))
    found = found.withColumn("delta_st", delta_from_f0(F.col("f0"))).withColumn("voiced_frames", F.size("f0"))
    return found.withColumn("contour", contour(F.col("delta_st"))).drop("f0")


def glide(rate: int, start: float, end: float, seconds: float, glide_s: float) -> np.ndarray:
    """A tone of six harmonics that glides at its end."""
    n, m = int(rate * seconds), int(rate * glide_s)
    f = np.concatenate([np.full(n - m, start), np.geomspace(start, end, m)])
    phase = 2 * np.pi * np.cumsum(f) / rate
    return sum(np.sin(k * phase) / k for k in range(1, 7)).astype(np.float32) * 0.2


# mastering -----------------------------------------------------------------


#: Up to so many columns the filters go through plain floats, which are faster there and give the same bits.
NARROW = 12
#: Samples of waves that are mastered together, padding included.
BLOCK = 1 << 21


def biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    """A second-order filter along the first axis, of all columns at once."""
    x = np.asarray(x, np.float64)
    b0, b1, b2 = (v / a[0] for v in b)
    a1, a2 = a[1] / a[0], a[2] / a[0]
    if x.ndim == 2 and x.shape[1] <= NARROW:
        out = np.empty_like(x)
        for k in range(x.shape[1]):
            s1 = s2 = 0.0
            column = []
            for v in x[:, k].tolist():
                y = b0 * v + s1
                s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
                column.append(y)
            out[:, k] = column
        return out
    out = np.empty_like(x)
    s1, s2, t = np.zeros(x.shape[1:]), np.zeros(x.shape[1:]), np.empty(x.shape[1:])
    for v, y in zip(x, out, strict=True):
        np.multiply(v, b0, out=y)
        y += s1
        np.multiply(v, b1, out=s1)
        np.multiply(y, a1, out=t)
        s1 -= t
        s1 += s2
        np.multiply(v, b2, out=s2)
        np.multiply(y, a2, out=t)
        s2 -= t
    return out


def highpass(rate: int, hz: float, q: float = 2**-0.5) -> tuple[tuple, tuple]:
    w = 2 * math.pi * hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    return ((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)


def shelf(rate: int, hz: float = 1681.974450955533, gain: float = 3.999843853973347, q: float = 0.7071752369554196) -> tuple[tuple, tuple]:
    k, vh = math.tan(math.pi * hz / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    return ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0), (1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)


def weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """The samples as loudness weighs them."""
    return biquad(biquad(x, *shelf(rate)), *highpass(rate, 38.13547087602444, 0.5003270373238773))


def gated(y: np.ndarray, rate: int) -> float:
    """Loudness of weighted samples, with both gates."""
    size, hop = int(0.4 * rate), int(0.1 * rate)
    sums = np.concatenate([np.zeros((1, y.shape[1])), np.cumsum(y**2, axis=0)])
    starts = np.arange(0, len(y) - size + 1, hop)
    power = ((sums[starts + size] - sums[starts]) / size).sum(axis=1)
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-20))
    loud = power[level > -70]
    if not len(loud):
        return -math.inf
    gate = -0.691 + 10 * math.log10(loud.mean()) - 10
    loud = power[(level > -70) & (level > gate)]
    return -0.691 + 10 * math.log10(loud.mean()) if len(loud) else -math.inf


def loudness(x: np.ndarray, rate: int) -> float:
    """Integrated loudness of [sample, channel] with both gates; minus infinity for silence."""
    return gated(weighted(x, rate), rate)


def _limit(x: np.ndarray, ceiling: float) -> np.ndarray:
    knee = LIMIT_KNEE * ceiling
    over = np.abs(x) > knee
    out = x.copy()
    out[over] = np.sign(x[over]) * (knee + (ceiling - knee) * (1 - 1e-7) * np.tanh((np.abs(x[over]) - knee) / (ceiling - knee)))
    return out


def mastered(x: np.ndarray, rate: int, cfg: MasterConfig) -> tuple[np.ndarray, float]:
    """([sample, channel], loudness): high pass, layout, one gain to the target loudness, limiter."""
    return mastered_block([x], rate, cfg)[0]


def mastered_block(waves: list[np.ndarray], rate: int, cfg: MasterConfig) -> list[tuple[np.ndarray, float]]:
    """``mastered`` of several waves, filtered side by side; zeros after the shorter ones change nothing before them."""
    sizes = [len(x) for x in waves]
    block = np.zeros((max(sizes), len(waves)))
    for k, x in enumerate(waves):
        block[: sizes[k], k] = x
    block = biquad(block, *highpass(rate, cfg.highpass_hz))
    ceiling, least = db(cfg.ceiling_db), int(0.4 * rate)
    wide = lambda block, k: np.repeat(block[: sizes[k], k : k + 1], cfg.channels, axis=1)  # noqa: E731, the channels are the same
    heavy = weighted(block, rate)
    for k, size in enumerate(sizes):
        own = block[:size, k]
        if size >= least and math.isfinite(now := gated(wide(heavy, k), rate)):
            own *= db(cfg.loudness_lufs - now)
        block[:size, k] = _limit(own, ceiling)
        block[size:, k] = 0
    heavy = weighted(block, rate)
    return [(wide(block, k).astype(np.float32), gated(wide(heavy, k), rate) if size >= least else math.nan) for k, size in enumerate(sizes)]


def blocks(sizes: list[int], most: int = BLOCK) -> list[list[int]]:
    """Indices of waves in blocks of at most so many samples (or of one wave), none more than half padding."""
    out: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if out and sizes[k] <= 2 * sizes[out[-1][0]] and sizes[k] * (len(out[-1]) + 1) <= most:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def master(scripts: DataFrame, rate: int, cfg: MasterConfig = MasterConfig(), keys: tuple[str, ...] = ("script_id",)) -> DataFrame:
    """(keys, audio interleaved, channels, duration_s, loudness_lufs, peak_dbfs) of each script's mix; nothing is shuffled."""
    kept = scripts.select(*keys, "audio")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("audio").schema) + ", audio array<float>, channels int, duration_s double, loudness_lufs double, peak_dbfs double"

    def run(parts):
        for part in parts:  # as Arrow: pandas would make every sample an object
            audio = part.column("audio")
            at, flat = audio.offsets.to_numpy(), audio.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            for block in blocks(np.diff(at).tolist()):
                made = mastered_block([flat[at[k] : at[k + 1]] for k in block], rate, cfg)
                peaks = [float(np.abs(y).max(initial=0)) for y, _ in made]
                ends = np.cumsum([0, *(y.size for y, _ in made)], dtype=np.int32)
                columns = {
                    **{k: part.column(k).take(pa.array(block)) for k in keys},
                    "audio": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([y.ravel() for y, _ in made]))),
                    "channels": pa.array([cfg.channels] * len(block), pa.int32()),
                    "duration_s": pa.array([len(y) / rate for y, _ in made], pa.float64()),
                    "loudness_lufs": pa.array([lufs for _, lufs in made], pa.float64()),
                    "peak_dbfs": pa.array([20 * math.log10(peak) if peak else -math.inf for peak in peaks], pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return kept.mapInArrow(run, schema)


def corrupted(items: Column, kind: Column, at: Column) -> Column:
    """An array of sentences (or of their audio) with one dropped, repeated or swapped with the next, or cut off there."""
    n = F.size(items)
    before, own, after = F.slice(items, F.lit(1), at), F.slice(items, at + 1, F.lit(1)), F.slice(items, at + 2, n)
    return (
        F.when(kind == "drop", F.concat(before, after))
        .when(kind == "duplicate", F.concat(before, own, own, after))
        .when(kind == "truncate", before)
        .when(kind == "swap", F.concat(before, F.slice(items, at + 2, F.lit(1)), own, F.slice(items, at + 3, n)))
        .otherwise(items)
    )
