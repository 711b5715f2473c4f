"""Audio files to segments and vectors. Samples never leave a Python worker: a table holds what was found in them.

Input is binaryFile rows (path, content) of PCM WAV files. Detector and embedder are the deterministic defaults of
the plug-ins: energy against the file's noise floor, and band energies of a spectrum.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoq.functions.text import meeting_of

RATE = 16_000
#: A file's bytes to mono samples from -1 to 1 at RATE; one for other formats than WAV (MP4, MP3) is given by the user.
Decoder = Callable[[bytes], np.ndarray]


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").load(path)
    return f.select(meeting_of(F.col("path")).alias("meeting_id"), "path", "content")


def decode(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples from -1 to 1 at the given rate: channels averaged, linear interpolation between samples."""
    with wave.open(io.BytesIO(content)) as w:
        n, width, channels, own = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float32) / 0x800000 - 1
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    if own == rate or not len(x):
        return x
    at = np.arange(int(len(x) * rate / own)) * (own / rate)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def detect(x: np.ndarray, rate: int = RATE, frame_ms: int = 10, factor: float = 4.0, least_speech: int = 100, least_silence: int = 50, most: int = 3_000) -> list[tuple[int, int]]:
    """(start_ms, end_ms) of speech: frames louder than factor times the noise floor, short silences filled, short
    bursts dropped, long stretches cut at `most`.
    """
    size = rate * frame_ms // 1000
    frames = x[: len(x) // size * size].reshape(-1, size)
    if not len(frames):
        return []
    loud = np.sqrt((frames**2).mean(1))
    on = loud > max(factor * float(np.quantile(loud, 0.1)), 1e-3)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    out: list[list[int]] = []
    for s, e in zip((edge[::2] * frame_ms).tolist(), (edge[1::2] * frame_ms).tolist(), strict=True):
        if out and s - out[-1][1] < least_silence:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(a, min(a + most, e)) for s, e in out if e - s >= least_speech for a in range(s, e, most)]


def speech_segments(files: DataFrame, decoder: Decoder = decode) -> DataFrame:
    """(meeting_id, seq, start_ms, end_ms) of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, i, s, e) for m, c in zip(pdf["meeting_id"], pdf["content"], strict=True) for i, (s, e) in enumerate(detect(decoder(c)))]
            yield pd.DataFrame(rows, columns=["meeting_id", "seq", "start_ms", "end_ms"])

    return files.select("meeting_id", "content").mapInPandas(run, "meeting_id string, seq long, start_ms long, end_ms long")


def loudness_track(x: np.ndarray, rate: int = RATE, frame_ms: int = 10, factor: float = 4.0) -> np.ndarray:
    """A stand-in for a model's probabilities of speech, one a frame: 0.5 where a frame is `factor` times as loud as the noise floor."""
    size = rate * frame_ms // 1000
    frames = x[: len(x) // size * size].reshape(-1, size)
    if not len(frames):
        return np.zeros(0)
    power = (frames.astype(float) ** 2).mean(1)
    floor = max(factor * float(np.quantile(np.sqrt(power), 0.1)), 1e-3) ** 2
    return power / (power + floor)


def speech_of_track(p: np.ndarray, frame_ms: int = 10, on: float = 0.1, off: float | None = None, least_speech: int = 100, least_silence: int = 50, most: int = 3_000) -> list[tuple[int, int]]:
    """(start_ms, end_ms) of speech in a track of probabilities.

    Speech begins at a frame of at least `on` and goes on until frames stay below `off` (by default 0.15 less, 0.01 at
    least) for least_silence; it ends where they began to. Stretches shorter than least_speech are dropped. One longer than
    `most` is cut before its least probable frame (of several the last) between least_speech and most after its start.
    """
    off = max(on - 0.15, 0.01) if off is None else off
    quiet, short, long = (max(1, -(-ms // frame_ms)) for ms in (least_silence, least_speech, most))
    heard = np.flatnonzero(p >= off)  # frames that keep speech going
    out: list[tuple[int, int]] = []
    at = 0
    while True:
        begins = np.flatnonzero(p[at:] >= on)
        if not len(begins):
            break
        s = at + int(begins[0])
        after = heard[np.searchsorted(heard, s) :]
        apart = np.flatnonzero(np.diff(after) > quiet)  # so many frames below `off` in between
        last = int(after[apart[0]]) if len(apart) else int(after[-1])
        e = last + 1
        at = e
        while e - s > long:
            inner = p[s + short : s + long + 1]
            cut = s + short + len(inner) - 1 - int(np.argmin(inner[::-1]))
            out.append((s, cut))
            s = cut
        if e - s >= short:
            out.append((s, e))
    return [(s * frame_ms, e * frame_ms) for s, e in out if e - s >= short]


def speech_of_tracks(tracks: DataFrame, frame_ms: int = 10, **limits: float) -> DataFrame:
    """(meeting_id, seq, start_ms, end_ms) from (meeting_id, track array<double>), a model's probabilities of speech by frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, i, s, e) for m, t in zip(pdf["meeting_id"], pdf["track"], strict=True) for i, (s, e) in enumerate(speech_of_track(np.asarray(t, float), frame_ms, **limits) if t is not None else [])]
            yield pd.DataFrame(rows, columns=["meeting_id", "seq", "start_ms", "end_ms"])

    kind = tracks.schema["meeting_id"].dataType.simpleString()
    return tracks.select("meeting_id", "track").mapInPandas(run, f"meeting_id {kind}, seq long, start_ms long, end_ms long")


def loudness_tracks(files: DataFrame, decoder: Decoder = decode) -> DataFrame:
    """(meeting_id, track) of each file, for speech_of_tracks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"meeting_id": pdf["meeting_id"], "track": [loudness_track(decoder(c)).tolist() for c in pdf["content"]]})

    return files.select("meeting_id", "content").mapInPandas(run, "meeting_id string, track array<double>")


def embed_frames(x: np.ndarray, crops: int = 3, length: int = RATE // 2, frame: int = 400, hop: int = 320, bands: int = 32, seed: int = 0) -> np.ndarray:
    """The second embedding, for short segments: crops at peak 1, band energies by frame averaged over time, then over crops; of length 1.

    A segment shorter than a crop is mirrored at both ends, or gets silence there if it is too short for that.
    """
    missing = length - len(x)
    if missing > 0:
        left, right = missing // 2, missing - missing // 2
        x = np.pad(x, (left, right), mode="reflect" if len(x) > max(1, left, right) else "constant")
    last = len(x) - length
    starts = [last // 2, *np.random.default_rng((seed, len(x))).integers(0, last + 1, crops - 1).tolist()]
    out = []
    for s in starts:
        crop = x[s : s + length] / (np.abs(x[s : s + length]).max(initial=0) + 1e-9)
        frames = np.lib.stride_tricks.sliding_window_view(crop, frame)[::hop] * np.hanning(frame)
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        edges = np.unique(np.geomspace(1, power.shape[1], bands + 1).astype(int))
        out.append(np.log1p(np.add.reduceat(power, edges[:-1], axis=1)).mean(0))
    v = np.mean(out, axis=0)
    return (v / (np.linalg.norm(v) + 1e-9)).astype(np.float32)


def embed(x: np.ndarray, crops: int = 3, length: int = RATE, bands: int = 32, seed: int = 0) -> np.ndarray:
    """Mean of the crops' band energies, of length 1: a crop in the middle and others drawn at random (the same for the
    same seed and length); short segments get silence on both sides.
    """
    if len(x) < length:
        left = (length - len(x)) // 2
        x = np.pad(x, (left, length - len(x) - left))
    last = len(x) - length
    starts = [last // 2, *np.random.default_rng((seed, len(x))).integers(0, last + 1, crops - 1).tolist()]
    power = np.abs(np.fft.rfft(np.stack([x[s : s + length] for s in starts]) * np.hanning(length), axis=1)) ** 2
    edges = np.unique(np.geomspace(1, power.shape[1], bands + 1).astype(int))
    v = np.log1p(np.add.reduceat(power, edges[:-1], axis=1)).mean(0)
    return (v / (np.linalg.norm(v) + 1e-9)).astype(np.float32)


def segment_embeddings(files: DataFrame, segments: DataFrame, decoder: Decoder = decode, embedder: Callable[[np.ndarray], np.ndarray] = embed) -> DataFrame:
    """(meeting_id, seq, embedding) for each segment, by embed or embed_frames; a file's segments come with it, so it is decoded once."""
    per = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms"))).alias("segments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, c, segs in zip(pdf["meeting_id"], pdf["content"], pdf["segments"], strict=True):
                x = decoder(c)
                rows += [(m, s["seq"], embedder(x[s["start_ms"] * RATE // 1000 : s["end_ms"] * RATE // 1000])) for s in segs]
            yield pd.DataFrame(rows, columns=["meeting_id", "seq", "embedding"])

    return files.select("meeting_id", "content").join(per, "meeting_id").mapInPandas(run, "meeting_id string, seq long, embedding array<float>")


# Decoding of recognisers' outputs ------------------------------------------------------------------------------------


def ctc_greedy(log_probs: np.ndarray, alphabet: list[str], blank: int = 0) -> str:
    best = log_probs.argmax(1)
    kept = [i for k, i in enumerate(best.tolist()) if i != blank and (k == 0 or i != best[k - 1])]
    return "".join(alphabet[i] for i in kept)


def ctc_beam(log_probs: np.ndarray, alphabet: list[str], beam: int = 10, top: int = 8, blank: int = 0) -> str:
    """Prefix beam search: for each prefix the log probabilities of ending in a blank and in its last symbol."""
    beams = {(): (0.0, -np.inf)}
    for row in log_probs:
        now: dict[tuple, tuple[float, float]] = {}

        def add(prefix: tuple, in_blank: float, in_symbol: float, now: dict = now) -> None:
            b, s = now.get(prefix, (-np.inf, -np.inf))
            now[prefix] = (np.logaddexp(b, in_blank), np.logaddexp(s, in_symbol))

        for prefix, (b, s) in beams.items():
            for i in {*np.argsort(-row)[:top].tolist(), blank}:
                p = float(row[i])
                if i == blank:
                    add(prefix, np.logaddexp(b, s) + p, -np.inf)
                elif prefix and i == prefix[-1]:
                    add(prefix, -np.inf, s + p)
                    add((*prefix, i), -np.inf, b + p)
                else:
                    add((*prefix, i), -np.inf, np.logaddexp(b, s) + p)
        beams = dict(sorted(now.items(), key=lambda x: (-np.logaddexp(*x[1]), x[0]))[:beam])
    return "".join(alphabet[i] for i in max(beams, key=lambda x: np.logaddexp(*beams[x])))


def decoded(frames: DataFrame, alphabet: list[str], method: str = "beam") -> DataFrame:
    """(all columns but log_probs, text) from log_probs array<array<double>> (frames by symbols)."""
    one = {"beam": ctc_beam, "greedy": ctc_greedy}[method]

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([one(np.array([list(r) for r in m], float), alphabet) if len(m) else "" for m in x])

    return frames.withColumn("text", run("log_probs")).drop("log_probs")


def forced_alignment(log_probs: np.ndarray, symbols: list[int], blank: int = 0) -> list[tuple[int, int]] | None:
    """(first frame, last frame) of each symbol on the most probable path that spells them; None if there are too few frames.

    The path goes through blanks and symbols in turn. Blanks may be left out except between two equal symbols. Of equally
    probable steps it takes the one from the state farthest along.
    """
    states = [blank]
    for x in symbols:
        states += [x, blank]
    skips = np.array([i >= 2 and states[i] != blank and states[i] != states[i - 2] for i in range(len(states))])
    emit = log_probs[:, states]
    score = np.full(len(states), -np.inf)
    score[:2] = emit[0, :2]
    back = np.zeros(emit.shape, np.int8)
    for t in range(1, len(emit)):
        from_ = np.stack([score, np.r_[-np.inf, score[:-1]], np.where(skips, np.r_[-np.inf, -np.inf, score[:-2]][: len(score)], -np.inf)])
        back[t] = from_.argmax(0)
        score = from_.max(0) + emit[t]
    at = len(states) - 1 if len(states) == 1 or score[-1] >= score[-2] else len(states) - 2
    if not np.isfinite(score[at]):
        return None
    first, last = {}, {}
    for t in range(len(emit) - 1, -1, -1):
        if at % 2:
            first[at // 2] = t
            last.setdefault(at // 2, t)
        at -= int(back[t, at])
    return [(first[i], last[i]) for i in range(len(symbols))]


def word_times(frames: DataFrame, alphabet: list[str], frame_ms: int = 20, blank: int = 0) -> DataFrame:
    """(meeting_id, chunk_idx, word_idx, word, start_ms, end_ms) of the words of recognised texts.

    frames: meeting_id, chunk_idx, start_ms (of the chunk), text and log_probs array<array<double>> (frames by symbols). The
    text's characters are aligned with the frames; those that the alphabet lacks are left out, and words without any other
    have no row. A word begins with its first character's first frame and ends after its last one's last. Chunks with fewer
    frames than their text needs, or a null in any column, have no words.
    """
    of = {c: i for i, c in enumerate(alphabet) if i != blank}

    def words(text: str, log_probs: np.ndarray, start: int) -> Iterator[tuple[int, str, int, int]]:
        names = [w for w in text.split() if any(c in of for c in w)]
        known = [(k, of[c]) for k, w in enumerate(names) for c in (w + " " if k + 1 < len(names) else w) if c in of]
        spans = forced_alignment(log_probs, [s for _, s in known], blank) if len(log_probs) and known else None
        own: dict[int, list[tuple[int, int]]] = {}
        for (k, s), span in zip(known, spans or [], strict=bool(spans)):
            if s != of.get(" "):
                own.setdefault(k, []).append(span)
        for i, (k, found) in enumerate(sorted(own.items())):
            yield i, names[k], start + found[0][0] * frame_ms, start + (found[-1][1] + 1) * frame_ms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (m, c, *w) for m, c, s, t, p in zip(*(pdf[x] for x in ("meeting_id", "chunk_idx", "start_ms", "text", "log_probs")), strict=True)
                if t is not None and p is not None and not pd.isna(s) for w in words(t, np.array([list(r) for r in p], float), int(s))
            ]
            yield pd.DataFrame(rows, columns=["meeting_id", "chunk_idx", "word_idx", "word", "start_ms", "end_ms"])

    kind = frames.schema["meeting_id"].dataType.simpleString()
    return frames.select("meeting_id", "chunk_idx", "start_ms", "text", "log_probs").mapInPandas(run, f"meeting_id {kind}, chunk_idx long, word_idx long, word string, start_ms long, end_ms long")
