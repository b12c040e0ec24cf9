"""Document readers: text, office, image, audio and video files to rows with metadata."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vecsmith.functions import text as T
from vecsmith.functions.embed import embedded
from vecsmith.operators.aggregates import mean_vectors

_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Decoders by extension, for types that need a library of their own: bytes -> text.
_TEXT_DECODERS: dict[str, Callable[[bytes], str]] = {}
#: Frame decoder for videos: bytes -> (list of encoded frames, fps, width, height).
_FRAMES: list[Callable] = []


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processor file, one a line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD_NS}t")) for p in root.iter(f"{_WORD_NS}p"))


def register_text_decoder(ext: str, decode: Callable[[bytes], str]) -> None:
    """A decoder for a text type, e.g. pdf (none is built in for it)."""
    _TEXT_DECODERS[ext] = decode


def register_frame_decoder(decode: Callable) -> None:
    _FRAMES[:] = [decode]


register_text_decoder("docx", docx_text)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_name, file_type, modality, file_size, modified, content) of all files under a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.substring_index("path", "/", -1).alias("file_name"), T.extension(F.col("path")).alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")
    return named.withColumn("modality", T.modality(F.col("file_type")))


def accepted_files(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of known types, and the others."""
    return df.where("modality is not null"), df.where("modality is null")


def decoded_text(df: DataFrame) -> DataFrame:
    """Text files with ``text``, or an ``error``; plain ones decode in the JVM, others by their decoder."""
    decoders = dict(_TEXT_DECODERS)

    @pandas_udf("text string, error string")
    def by_library(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = []
        for c, k in zip(content, kind, strict=True):
            try:
                rows.append((decoders[k](c), None))
            except KeyError:
                rows.append((None, f"no decoder for {k}"))
            except Exception as e:  # one broken file must not stop the others
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    plain = df.where(F.col("file_type").isin("txt", "md")).withColumn("text", F.decode("content", "UTF-8")).withColumn("error", F.lit(None).cast("string"))
    other = df.where((F.col("modality") == "text") & ~F.col("file_type").isin("txt", "md")).withColumn("_d", by_library("content", "file_type"))
    return plain.unionByName(other.withColumn("text", F.col("_d.text")).withColumn("error", F.col("_d.error")).drop("_d"))


def text_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``content_length`` (characters) and ``word_count``."""
    return df.withColumns({"content_length": F.length(F.coalesce(F.col(text), F.lit(""))), "word_count": T.word_count(F.col(text))})


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, mode, pixels) by Spark's image source."""
    got = spark.read.format("image").option("dropInvalid", "true").load(path)
    mode = F.when(F.col("image.nChannels") == 1, "L").when(F.col("image.nChannels") == 3, "RGB").otherwise("RGBA")
    return got.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), mode.alias("mode"), F.col("image.data").alias("pixels"))


def as_rgb(df: DataFrame, pixels: str = "pixels", mode: str = "mode") -> DataFrame:
    """``df`` with its pixels as RGB bytes, whatever their mode: grey (L), blue-green-red (RGB by ``images``) or with a fourth, dropped channel (RGBA)."""

    @pandas_udf("binary")
    def turned(content: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for c, kind in zip(content, kinds, strict=True):
            if c is None or kind is None:
                out.append(None)
                continue
            x = np.frombuffer(c, np.uint8).reshape(-1, {"L": 1, "RGB": 3, "RGBA": 4}[kind])
            out.append(np.repeat(x, 3, axis=1).tobytes() if kind == "L" else np.ascontiguousarray(x[:, 2::-1]).tobytes())
        return pd.Series(out)

    return df.withColumn(pixels, turned(pixels, mode)).withColumn(mode, F.lit("RGB"))


def image_vectors(spark: SparkSession, path: str, embedder: str = "colour-image") -> DataFrame:
    """(path, width, height, embedding): images turned to RGB, then embedded by their pixels."""
    return as_rgb(images(spark, path)).select("path", "width", "height", embedded(F.col("pixels"), embedder).alias("embedding"))


def video_vectors(df: DataFrame, embedder: str = "hashing-bytes", most: int = 10) -> DataFrame:
    """(path, mean_vector): the element-wise mean of the vectors of a video's first ``most`` frames."""
    vectors = frames(df, most).select("path", embedded(F.col("content"), embedder).alias("embedding"))
    return mean_vectors(vectors, ["path"])


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and the rate of a PCM wave file."""
    import wave

    with wave.open(io.BytesIO(content)) as w:
        kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
        x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float32).reshape(-1, w.getnchannels()).mean(axis=1)
        return ((x - 128) / 128 if kind is np.uint8 else x / float(np.iinfo(kind).max)), w.getframerate()


def audio(df: DataFrame) -> DataFrame:
    """Adds ``audio`` (samples, sample_rate, num_samples, duration, error) to audio files."""

    @pandas_udf("samples array<float>, sample_rate int, num_samples long, duration double, error string")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                x, rate = wav_samples(c)
                rows.append((x, rate, len(x), len(x) / rate, None))
            except Exception as e:  # one broken file must not stop the others
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["samples", "sample_rate", "num_samples", "duration", "error"]).astype({"sample_rate": "Int32", "num_samples": "Int64"})

    return df.where(F.col("modality") == "audio").withColumn("audio", decode("content"))


def frames(df: DataFrame, most: int | None = None) -> DataFrame:
    """(path, frame, content, fps, total_frames, width, height) of video files, by the registered decoder."""
    if not _FRAMES:
        raise RuntimeError("no frame decoder is registered")
    decode = _FRAMES[0]

    def rows(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                got, fps, width, height = decode(content)
                for i, frame in enumerate(got[:most]):
                    yield pd.DataFrame({"path": [path], "frame": [i], "content": [frame], "fps": [float(fps)], "total_frames": [len(got)], "width": [width], "height": [height]})

    return df.where(F.col("modality") == "video").select("path", "content").mapInPandas(rows, "path string, frame int, content binary, fps double, total_frames long, width int, height int")
