"""What a file is: its media type from the first bytes, the name only breaking ties.

All of it is column expressions over a binary head (its first 8192 bytes) and a name.
A null or empty head is text: an empty file extracts to nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 8192
_OFFICE = "application/vnd.openxmlformats-officedocument."
DOCX, PPTX, XLSX = (_OFFICE + x for x in ("wordprocessingml.document", "presentationml.presentation", "spreadsheetml.sheet"))

# Signatures (hex), containers, brands, byte-order marks and text types by extension.
SIGNATURES = (
    ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("89504E470D0A1A0A", "image/png"),
    ("526172211A07", "application/vnd.rar"),
    ("255044462D", "application/pdf"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("1A45DFA3", "video/x-matroska"),
    ("7F454C46", "application/x-executable"),
    ("4F676753", "audio/ogg"),
    ("664C6143", "audio/flac"),
    ("504B0304", "application/zip"),
    ("FFD8FF", "image/jpeg"),
    ("494433", "audio/mpeg"),
    ("1F8B", "application/gzip"),
    ("424D", "image/bmp"),
    ("4D5A", "application/vnd.microsoft.portable-executable"),
)
CONTAINERS = {"docx": DOCX, "pptx": PPTX, "xlsx": XLSX, "epub": "application/epub+zip"}
BRANDS = {"71742020": "video/quicktime", "4D344120": "audio/mp4", "4D345620": "video/x-m4v", "68656963": "image/heic", "61766966": "image/avif"}
MARKS = (("EFBBBF", "utf-8-sig"), ("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
TEXT_TYPES = {
    "text/plain": "txt text log ini cfg",
    "text/markdown": "md markdown",
    "text/x-rst": "rst",
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/json": "json",
    "application/x-ndjson": "jsonl ndjson",
    "application/yaml": "yaml yml",
    "application/xml": "xml",
    "text/html": "html htm",
    "text/x-python": "py",
    "text/javascript": "js mjs",
    "text/x-typescript": "ts",
    "text/x-tsx": "tsx",
    "text/x-jsx": "jsx",
    "text/x-go": "go",
    "text/x-java": "java",
    "text/x-ruby": "rb",
    "text/x-rust": "rs",
    "application/sql": "sql",
    "application/x-sh": "sh bash",
    "text/x-c": "c h",
    "text/x-c++": "cpp hpp cc",
    "text/x-csharp": "cs",
    "text/x-php": "php",
    "text/x-kotlin": "kt",
    "text/x-swift": "swift",
    "application/toml": "toml",
}
TEXT, BINARY = "text/plain", "application/octet-stream"
#: Control bytes that nobody types: all but tab, newline, form feed, carriage return and escape.
TYPED = "\t\n\f\r\x1b"
CONTROL_SHARE = 0.02


def extension(name: Column) -> Column:
    """The lower-cased last extension without its dot, or the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]+)$", 1))


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def bom_encoding(head: Column) -> Column:
    """The encoding that a byte-order mark states, or null."""
    return _first([(F.startswith(F.hex(head), F.lit(m)), F.lit(e)) for m, e in MARKS], F.lit(None).cast("string"))


def looks_like_text(head: Column) -> Column:
    """A byte-order mark settles it; else no NUL, and under two percent of control bytes."""
    chars = F.decode(head, "ISO-8859-1")
    controls = F.length(F.regexp_replace(F.translate(chars, TYPED, ""), r"[^\x00-\x1f]", ""))
    size = F.coalesce(F.length(head), F.lit(0))
    clean = ~F.contains(chars, F.lit("\0")) & (controls < CONTROL_SHARE * size)
    return (size == 0) | bom_encoding(head).isNotNull() | clean


def sniff(head: Column, name: Column) -> Column:
    """The media type; what has a signature is never overruled by its name, but for documents in ZIP containers."""
    digits, suffix = F.hex(F.coalesce(head, F.lit(b""))), extension(name)
    by_name = _first([(suffix == s, F.lit(t)) for s, t in CONTAINERS.items()], F.lit("application/zip"))
    signed = [(F.startswith(digits, F.lit(m)), by_name if t == "application/zip" else F.lit(t)) for m, t in SIGNATURES]
    brand = _first([(F.substring(digits, 17, 8) == b, F.lit(t)) for b, t in BRANDS.items()], F.lit("video/mp4"))
    media = (F.length(digits) >= 24) & (F.substring(digits, 9, 8) == "66747970")
    text = _first([(suffix.isin(*s.split()), F.lit(t)) for t, s in TEXT_TYPES.items()], F.lit(TEXT))
    return _first([*signed, (media, brand), (looks_like_text(head), text)], F.lit(BINARY))


def is_text(media_type: Column) -> Column:
    """Characters, so that an extension may choose the extractor."""
    return F.startswith(media_type, F.lit("text/")) | media_type.isin(*TEXT_TYPES)
