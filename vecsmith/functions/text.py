"""Text, name and file-type functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: the ASCII kinds, the separators U+001C to U+001F, and Unicode spaces.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: File extensions by modality.
MODALITIES = {
    "text": ["txt", "md", "docx", "pdf"],
    "image": ["jpg", "jpeg", "png", "bmp"],
    "video": ["mp4", "avi", "mov"],
    "audio": ["mp3", "wav"],
}


def cleaned(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words(text: Column) -> Column:
    """The words in order; none for an empty text."""
    text = cleaned(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def word_count(text: Column) -> Column:
    """Words between runs of white space; 0 for null."""
    text = cleaned(F.coalesce(text, F.lit("")))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def chunks(text: Column, size: int = 100) -> Column:
    """Windows of ``size`` words without overlap, joined by spaces; an empty text is one empty chunk."""
    if size < 1:
        raise ValueError("chunks need at least one word")
    # runs of up to ``size`` words of the cleaned text, found by one pass over it
    found = F.regexp_extract_all(cleaned(F.coalesce(text, F.lit(""))), F.lit(f"(?:[^ ]++ ){{0,{size - 1}}}+[^ ]++"), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def chunk_id(file_id: Column, index: Column) -> Column:
    return F.concat(file_id.cast("string"), F.lit("_chunk_"), index.cast("string"))


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content.cast("binary"), 256)


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part, empty if it has none."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def modality(ext: Column) -> Column:
    """text, image, video or audio; null for others."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, kinds in MODALITIES.items():
        out = out.when(ext.isin(kinds), name)
    return out


def processor(file_type: Column) -> Column:
    """The modality that processes a type, given as an extension or as a modality."""
    pairs = [x for m, kinds in MODALITIES.items() for k in [m, *kinds] for x in (F.lit(k), F.lit(m))]
    return F.try_element_at(F.create_map(*pairs), F.lower(file_type))


def accepted(ext: Column) -> Column:
    """The extension, or an error that stops the query."""
    return F.when(modality(ext).isNotNull(), ext).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), ext)))


def safe_name(path: Column) -> Column:
    """The last part of a path, without dot-dot."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.\.", "")
