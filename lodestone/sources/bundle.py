"""Archive bundles (S13): checks before anything is unpacked."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import shutil
import tarfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_EXPANSION = 4 * 1024**3, 200


class Unsafe(Exception):
    """The bundle must not be unpacked."""


def sniff(head: bytes) -> str:
    """What the first bytes say it is, whatever its name."""
    for kind, mark in (("zip", b"PK\x03\x04"), ("gzip", b"\x1f\x8b"), ("xz", b"\xfd7zXZ\x00"), ("bzip2", b"BZh")):
        if head.startswith(mark):
            return kind
    if head[257:262] == b"ustar":
        return "tar"
    if head.lstrip()[:1] == b"<":
        raise Unsafe("this is a web page, not a bundle")
    raise Unsafe("unknown kind of file")


def safe_member(name: Column) -> Column:
    """True for member names that stay inside the folder they are unpacked to."""
    return ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), "..")


def check_members(names: list[str]) -> None:
    for name in names:
        if name.startswith("/") or ".." in name.split("/") or posixpath.normpath(name).startswith(".."):
            raise Unsafe(f"unsafe path {name!r}")


def check_sha256(data: bytes, wanted: str | None) -> None:
    if wanted and hashlib.sha256(data).hexdigest() != wanted.lower():
        raise Unsafe("the checksum differs")


def download(url: str, target: Path, opener: Callable[[str], BinaryIO], wanted: str | None = None, limit: int = MAX_BYTES) -> str:
    """``url`` block by block into ``target``; returns the SHA-256. Only
    https, only up to ``limit`` bytes, only the wanted checksum; what fails
    leaves no file. ``opener(url)`` is the transport."""
    if not url.startswith("https://"):
        raise Unsafe("only https is accepted")
    seen, size = hashlib.sha256(), 0
    try:
        with opener(url) as source, open(target, "wb") as out:
            while block := source.read(1 << 20):
                size += len(block)
                if size > limit:
                    raise Unsafe("too large")
                seen.update(block)
                out.write(block)
        if wanted and seen.hexdigest() != wanted.lower():
            raise Unsafe("the checksum differs")
        with open(target, "rb") as f:
            sniff(f.read(512))
    except BaseException:
        target.unlink(missing_ok=True)
        raise
    return seen.hexdigest()


def check_layout(names: list[str]) -> None:
    """A bundle holds the archive that the readers know: an index of records, or
    folders with an ``index.md`` each."""
    if not any(re.search(r"(^|/)_index\.json$|/[^/]+/index\.md$", n) for n in names):
        raise Unsafe("this is no archive: neither an index nor pages")


def unpack_to(bundle: Path, folder: Path) -> list[str]:
    """The members of a checked bundle, each copied to ``folder`` as a stream;
    paths, links and expansion are checked before the first."""
    size = max(1, bundle.stat().st_size)
    with open(bundle, "rb") as f:
        kind = sniff(f.read(512))
    if kind == "zip":
        with zipfile.ZipFile(bundle) as z:
            found = [(i.filename, i.file_size, i) for i in z.infolist() if not i.is_dir()]
            return _copy(found, size, z.open, folder)
    with tarfile.open(bundle) as t:
        members = t.getmembers()
        if any(m.issym() or m.islnk() for m in members):
            raise Unsafe("links are not accepted")
        return _copy([(m.name, m.size, m) for m in members if m.isfile()], size, t.extractfile, folder)


def _copy(found: list[tuple], size: int, open_: Callable, folder: Path) -> list[str]:
    names = [name for name, _, _ in found]
    check_members(names)
    if sum(n for _, n, _ in found) > MAX_EXPANSION * size:
        raise Unsafe("expands too much")
    check_layout(names)
    for name, _, member in found:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open_(member) as source, open(path, "wb") as out:
            shutil.copyfileobj(source, out)
    return names


def unpack(data: bytes, wanted: str | None = None, https_url: str | None = None) -> dict[str, bytes]:
    """Members of a checked bundle: transport, size, kind, checksum, paths and
    expansion are checked first; links are never followed."""
    if https_url is not None and not https_url.startswith("https://"):
        raise Unsafe("only https is accepted")
    if len(data) > MAX_BYTES:
        raise Unsafe("too large")
    check_sha256(data, wanted)
    if sniff(data[:512]) == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            check_members([i.filename for i in infos])
            if sum(i.file_size for i in infos) > MAX_EXPANSION * max(1, len(data)):
                raise Unsafe("expands too much")
            return {i.filename: z.read(i) for i in infos}
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        members = t.getmembers()
        check_members([m.name for m in members])
        if any(m.issym() or m.islnk() for m in members):
            raise Unsafe("links are not accepted")
        if sum(m.size for m in members) > MAX_EXPANSION * max(1, len(data)):
            raise Unsafe("expands too much")
        return {m.name: t.extractfile(m).read() for m in members if m.isfile()}


def coverage(files: DataFrame) -> DataFrame:
    """``(part, files, bytes)`` of ``files(path, bytes)`` by the first folder."""
    part = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), 1)).otherwise(".")
    return files.groupBy(part.alias("part")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
