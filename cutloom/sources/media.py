"""Media files as DataFrames: hashes, WAV samples and headers, probe output, frames; and the pruning of files that no row names."""

from __future__ import annotations

import hashlib
import io
import json
import subprocess
import uuid
import wave
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length and content of binary files."""
    return spark.read.format("binaryFile").load(pattern)


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """path and SHA-256 of files."""
    return files(spark, pattern).select("path", F.sha2("content", 256).alias("sha256"))


def hash_file(path: str | Path, chunk: int = 1 << 20) -> str:
    """SHA-256 of one file, read in chunks; for files too large for a row."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def wav_samples(content: bytes, rate: int = 16000) -> np.ndarray:
    """Samples in [-1, 1) of a mono 16-bit WAV at exactly the rate; RuntimeError for any other."""
    with wave.open(io.BytesIO(content)) as w:
        if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 2, rate):
            raise RuntimeError(f"need mono 16-bit {rate} Hz, got {w.getnchannels()} channels, {8 * w.getsampwidth()} bits, {w.getframerate()} Hz")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768


def wav_seconds(content: bytes) -> float:
    """Length of a WAV from its header, without reading samples."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getnframes() / w.getframerate()


def header_seconds(head: bytes, size: int) -> float:
    """Length of a PCM WAV from its first bytes and the size of its file; ValueError if they hold no format and data chunk. A data size that was never filled in counts to the end of the file."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(head):
        name, length = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if name == b"fmt ":
            rate = int.from_bytes(head[at + 16 : at + 20], "little")  # bytes per second
        if name == b"data":
            if not rate:
                break
            there = size - at - 8
            return (there if length in (0, 0xFFFFFFFF) else min(length, there)) / rate
        at += 8 + length + length % 2
    raise ValueError("no format and data chunk in the first bytes")


def wav_durations(paths: DataFrame, first: int = 4096) -> DataFrame:
    """path, seconds and error of WAV files in a shared folder: only their first bytes are read, whatever their length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    with open(path.removeprefix("file:"), "rb") as file:
                        head = file.read(first)
                        out.append((path, header_seconds(head, file.seek(0, io.SEEK_END)), None))
                except (OSError, ValueError) as error:
                    out.append((path, None, str(error)[:300]))
            yield pd.DataFrame(out, columns=["path", "seconds", "error"])

    return paths.select("path").mapInPandas(run, "path string, seconds double, error string")


def wav_16k(content: Column | str) -> Column:
    """Samples of mono 16-bit WAV files at 16 kHz."""
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda c: wav_samples(bytes(c)))

    return F.pandas_udf(run, "array<float>")(content)


PROBE = "format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,pix_fmt:string,color_transfer:string,color_primaries:string,start_time:string,nb_read_frames:string>>"


def probe_fields(output: Column) -> Column:
    """STRUCT<duration, streams> out of a media probe's JSON; 'N/A' and absent numbers are null."""
    p = F.from_json(output, PROBE)
    number = lambda c: F.when(c != "N/A", c).try_cast("double")
    streams = F.transform(p["streams"], lambda s: s.withField("start_s", number(s["start_time"])).withField("frames", F.when(s["nb_read_frames"] != "N/A", s["nb_read_frames"]).try_cast("bigint")))
    return F.struct(number(p["format"]["duration"]).alias("duration"), streams.alias("streams"))


def counted_frames(stream: Column) -> Column:
    """The frames that a probe has counted; an error if it did not, as the length of a video must not be guessed."""
    return F.coalesce(stream["frames"], F.raise_error(F.lit("the probe counted no frames")).cast("bigint"))


def first_stream(probe: Column, codec_type: str) -> Column:
    """The first stream of a type; null without one."""
    return F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == codec_type), F.lit(0))


def run_tool(paths: DataFrame, command: Callable[[str], list[str]], timeout: float = 600.0) -> DataFrame:
    """path, output and error of an external program per path, run on the executors; a failure is a row with its error, not an exception."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    done = subprocess.run(command(path), capture_output=True, timeout=timeout, check=True)
                    out.append((path, done.stdout.decode(errors="replace"), None))
                except (OSError, subprocess.SubprocessError) as error:
                    out.append((path, None, str(error)[:500]))
            yield pd.DataFrame(out, columns=["path", "output", "error"])

    return paths.select("path").mapInPandas(run, "path string, output string, error string")


def made_once(files: DataFrame, command: Callable[[str, str], list[str]], timeout: float = 3600.0) -> DataFrame:
    """source, target, made and error for files (source, target) in a shared folder: a target that is there is kept, else a tool writes it aside, and it is renamed when whole.

    command(source, part) is the tool's command line: extraction of an audio track at some rate, an encoder, and the like. A tool that was stopped leaves no target.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, target in batch[["source", "target"]].itertuples(index=False, name=None):
                path = Path(target)
                if path.exists():
                    out.append((source, target, False, None))
                    continue
                path.parent.mkdir(parents=True, exist_ok=True)
                part = path.with_name(f".{uuid.uuid4().hex}-{path.name}")  # the ending stays, as tools go by it
                try:
                    subprocess.run(command(source, str(part)), capture_output=True, timeout=timeout, check=True)
                    part.replace(path)
                    out.append((source, target, True, None))
                except (OSError, subprocess.SubprocessError) as error:
                    part.unlink(missing_ok=True)
                    said = getattr(error, "stderr", None) or b""
                    out.append((source, target, False, (str(error) + ": " + said.decode(errors="replace")[-300:])[:600]))
            yield pd.DataFrame(out, columns=["source", "target", "made", "error"])

    return files.select("source", "target").mapInPandas(run, "source string, target string, made boolean, error string")


def audio_command(rate: int) -> Callable[[str, str], list[str]]:
    """The command that extracts a mono 16-bit WAV at a rate, on the clock of the video."""
    return lambda source, part: ["ffmpeg", "-y", "-i", source, "-vn", "-af", "aresample=async=1:first_pts=0", "-ac", "1", "-ar", str(rate), "-c:a", "pcm_s16le", "-f", "wav", part]


def download_command(url: str, template: str, height: int = 1080) -> list[str]:
    """The command that fetches a video of at most a height, as one file."""
    return ["yt-dlp", "-f", f"bestvideo[height<={height}]+bestaudio/best[height<={height}]/best", "--merge-output-format", "mp4", "-o", template, url]


def downloaded(urls: DataFrame, root: str, command: Callable[[str, str], list[str]] = download_command, attempts: int = 3, timeout: float = 7200.0) -> DataFrame:
    """url, path and error of addresses (url), each in a folder of its own under root, named by the hash of the address; a whole command is tried again, up to the attempts, and goes on with what it has."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                folder = Path(root) / hashlib.sha256(url.encode()).hexdigest()[:16]
                folder.mkdir(parents=True, exist_ok=True)
                error = None
                for _ in range(attempts):
                    try:
                        subprocess.run(command(url, str(folder / "source.%(ext)s")), capture_output=True, timeout=timeout, check=True)
                        error = None
                        break
                    except (OSError, subprocess.SubprocessError) as problem:
                        error = str(problem)[:500]
                found = sorted(x for x in folder.glob("source.*") if x.suffix != ".part")
                out.append((url, str(found[0]) if found and not error else None, error or (None if found else "no file was made")))
            yield pd.DataFrame(out, columns=["url", "path", "error"])

    return urls.select("url").mapInPandas(run, "url string, path string, error string")


def frame_command(path: str, seconds: float) -> list[str]:
    """The command that writes one frame as JPEG to its output."""
    return ["ffmpeg", "-v", "error", "-ss", f"{seconds:.6f}", "-i", path, "-frames:v", "1", "-f", "image2pipe", "-c:v", "mjpeg", "-"]


def frame_images(candidates: DataFrame, command: Callable[[str, float], list[str]] = frame_command, timeout: float = 120.0) -> DataFrame:
    """video_id, frame, content and error of frames (video_id, media_path, frame, seconds), decoded one by one on the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, path, frame, seconds in batch[["video_id", "media_path", "frame", "seconds"]].itertuples(index=False, name=None):
                content = error = None
                try:
                    content = subprocess.run(command(path, seconds), capture_output=True, timeout=timeout, check=True).stdout or None
                    error = None if content else f"frame {frame} of {path} cannot be decoded"
                except (OSError, subprocess.SubprocessError) as problem:
                    error = str(problem)[:500]
                yield pd.DataFrame({"video_id": [video], "frame": [frame], "content": [content], "error": [error]})

    return candidates.select("video_id", "media_path", "frame", "seconds").mapInPandas(run, "video_id string, frame bigint, content binary, error string")


def write_frames(images: DataFrame, folder: str) -> DataFrame:
    """Write images (video_id, frame, content) as f{frame:08d}.jpg under a shared folder per video: video_id, frame, frame_path (relative). Files are written aside and renamed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, frame, content in batch[["video_id", "frame", "content"]].itertuples(index=False, name=None):
                name = f"frames/f{frame:08d}.jpg"
                path = Path(folder) / video / name
                path.parent.mkdir(parents=True, exist_ok=True)
                draft = path.with_suffix(".part")
                draft.write_bytes(bytes(content))
                draft.replace(path)
                out.append((video, frame, name))
            yield pd.DataFrame(out, columns=["video_id", "frame", "frame_path"])

    return images.mapInPandas(run, "video_id string, frame bigint, frame_path string")


def prune_files(orphans: DataFrame) -> int:
    """Delete the files of a column path on the executors; the number that was there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = 0
            for path in batch["path"]:
                local = Path(path.removeprefix("file:"))
                gone += local.exists()
                local.unlink(missing_ok=True)
            yield pd.DataFrame({"n": [gone]})

    return orphans.select("path").mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row; null fields are left out."""
    df.select(F.to_json(F.struct("*"))).write.mode("overwrite").text(path)


def info(videos: DataFrame, video_id: str) -> str | None:
    """A video's row as JSON, with its speech flag; None if there is none."""
    row = videos.filter(F.col("video_id") == video_id).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    return row and json.dumps(json.loads(row["j"]), ensure_ascii=False)
