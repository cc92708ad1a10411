"""What a source is: scheme, format, compression, folder layout, delimiter, header, encoding."""

from __future__ import annotations

import csv
import glob as globbing
import gzip
import os
import re
from collections import Counter
from dataclasses import dataclass, field

from ..errors import SourceError

# File endings and URL schemes, and what they mean.
FORMATS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "psv": "csv", "txt": "csv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "parquet": "parquet", "pq": "parquet",
    "xlsx": "excel", "xls": "excel", "arrow": "arrow", "feather": "arrow", "ipc": "arrow", "orc": "orc", "avro": "avro", "sqlite": "sqlite", "sqlite3": "sqlite", "db": "sqlite",
    "duckdb": "duckdb", "sql": "pg_dump",
}
COMPRESSION = {"gz": "gzip", "zip": "zip", "zst": "zstd", "snappy": "snappy", "bz2": "bzip2"}
SCHEMES = {"s3": "s3", "s3a": "s3", "gs": "gcs", "gcs": "gcs", "az": "azure", "azure": "azure", "abfs": "azure", "abfss": "azure", "http": "http", "https": "http", "hdfs": "hdfs", "viewfs": "hdfs", "file": "local"}
DELIMITERS = (",", "\t", ";", "|")
SNIFFED, FOLDER_FILES = 16 * 1024, 1000


@dataclass
class Detection:
    path: str
    scheme: str
    format: str
    compression: str | None = None
    is_folder: bool = False
    hive_keys: list[str] = field(default_factory=list)
    delimiter: str | None = None
    header: bool | None = None
    encoding: str | None = None


def scheme_of(path: str) -> str:
    m = re.match(r"([A-Za-z][\w+.-]*)://", path)
    return SCHEMES.get(m[1].lower(), m[1].lower()) if m else "local"


def format_of(name: str) -> tuple[str | None, str | None]:
    """(format, compression) by a file's endings."""
    parts = os.path.basename(name).lower().split(".")
    compression = COMPRESSION.get(parts[-1]) if len(parts) > 1 else None
    if compression:
        parts = parts[:-1]
    return (FORMATS.get(parts[-1]) if len(parts) > 1 else None), compression


def head(path: str, n: int = SNIFFED) -> bytes:
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        return f.read(n)


def sniff(data: bytes) -> tuple[str, bool, str]:
    """(delimiter, header, encoding) of the start of a delimited text."""
    encoding = "utf-8"
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        # a character may be cut at the end of the sample
        if e.start > len(data) - 4:
            text = data[: e.start].decode("utf-8-sig")
        else:
            encoding, text = "latin-1", data.decode("latin-1")
    lines = [x for x in text.splitlines() if x.strip()][:50]
    if not lines:
        return ",", True, encoding
    widths = {d: Counter(len(next(csv.reader([x], delimiter=d))) for x in lines).most_common(1)[0] for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: (widths[d][0] > 1, widths[d][1], widths[d][0]))
    first = next(csv.reader([lines[0]], delimiter=best))

    def is_number(x: str) -> bool:
        return bool(re.fullmatch(r"\s*[-+]?\d+(\.\d+)?([eE][-+]?\d+)?\s*", x))

    header = len(set(first)) == len(first) and not any(is_number(x) or not x.strip() for x in first)
    return best, header, encoding


def detect(path: str, format: str | None = None) -> Detection:
    """Looks at a file, a folder, a glob or a URL. `format` overrides what is found."""
    scheme = scheme_of(path)
    local = path.removeprefix("file://") if scheme == "local" else path
    if scheme == "local" and (os.path.isdir(local) or any(c in local for c in "*?[")):
        out = _folder(local)
    else:
        if scheme == "local" and not os.path.exists(local):
            raise SourceError(f"no such file: {local}")
        found, compression = format_of(local)
        out = Detection(path, scheme, format or found or "", compression)
        if not out.format:
            raise SourceError(f"can't tell the format of {path!r}.", "Name it.")
    out.format = format or out.format
    first = local if not out.is_folder else next((f for f in _files(local) if format_of(f)[0] in ("csv", "tsv")), None)
    if out.format in ("csv", "tsv") and scheme == "local" and first and out.compression in (None, "gzip"):
        out.delimiter, out.header, out.encoding = sniff(head(first))
        if out.format == "tsv":
            out.delimiter = "\t"
    return out


def _files(path: str) -> list[str]:
    if any(c in path for c in "*?["):
        return sorted(f for f in globbing.glob(path, recursive=True) if os.path.isfile(f))[:FOLDER_FILES]
    out = []
    for d, dirs, names in os.walk(path):
        dirs.sort()
        out += [os.path.join(d, n) for n in sorted(names) if not n.startswith(("_", "."))]
        if len(out) >= FOLDER_FILES:
            break
    return out[:FOLDER_FILES]


def _folder(path: str) -> Detection:
    files = _files(path)
    if not files:
        raise SourceError(f"no files in {path!r}")
    kinds = Counter(k for f in files if (k := format_of(f)[0]))
    if not kinds:
        raise SourceError(f"no known format in {path!r}")
    kind = "parquet" if "parquet" in kinds else kinds.most_common(1)[0][0]
    base = path.split("*")[0]
    keys = list(dict.fromkeys(m[1] for m in re.finditer(r"/(\w+)=[^/]*(?=/)", files[0][len(base.rstrip("/")) :])))
    compression = format_of(next(f for f in files if format_of(f)[0] == kind))[1]
    return Detection(path, "local", kind, compression, True, keys)


def table_name(path: str) -> str:
    """A table's name from a path: without endings, words joined by _, lower case, no leading digit."""
    stem = os.path.basename(path.rstrip("/"))
    for _ in range(2):
        root, ext = os.path.splitext(stem)
        if ext[1:].lower() in COMPRESSION | FORMATS:
            stem = root
    name = re.sub(r"\W+", "_", stem).strip("_").lower() or "table"
    return f"t_{name}" if name[0].isdigit() else name
