"""Reading parts of large files: zip directories, single members, row ranges of stored arrays.

A task opens a file for random access and reads the bytes it needs, whatever
the file's size: the directory of an archive lies at its end, a member at a
known offset, the rows of an uncompressed array one after the other.  ``opener``
is a function from a URI to a seekable binary file, called in the tasks; the
default opens local paths and every store that ``pyarrow.fs`` knows.
"""
from __future__ import annotations

import struct
import zipfile
import zlib
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np

#: fixed value: bytes of a zip member's local header before its name
_LOCAL_HEADER = 30


def local_path(uri: str) -> str | None:
    """The path of a local URI, None for any other store."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def open_ranged(uri: str):
    """A seekable binary file for a local path or a store that ``pyarrow.fs`` can open."""
    local = local_path(uri)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def reachable(uri: str) -> bool:
    """Whether :func:`open_ranged` knows the store of ``uri``."""
    if local_path(uri) is not None:
        return True
    from pyarrow import fs
    try:
        fs.FileSystem.from_uri(uri)
        return True
    except Exception:  # noqa: BLE001 - an unknown scheme, or a client that is not installed
        return False


class Member(NamedTuple):
    """Where a zip member lies."""
    member: str
    offset: int
    stored: int
    method: int
    crc: int


def zip_directory(fh) -> list[Member]:
    """The members of an archive from its directory (of members that share a name, the last)."""
    with zipfile.ZipFile(fh) as z:
        return [Member(i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC) for i in z.NameToInfo.values() if not i.is_dir()]


def member_start(fh, offset: int) -> int:
    """Offset of a member's data."""
    fh.seek(offset)
    head = fh.read(_LOCAL_HEADER)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no zip member at offset {offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    return offset + _LOCAL_HEADER + name + extra


def read_member(fh, m: Member) -> bytes:
    """The bytes of one member, checked."""
    fh.seek(member_start(fh, m.offset))
    data = fh.read(m.stored)
    if m.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif m.method != zipfile.ZIP_STORED:
        raise ValueError(f"{m.member}: compression method {m.method} is not supported")
    if zlib.crc32(data) != m.crc:
        raise ValueError(f"{m.member}: checksum mismatch")
    return data


def array_header(f) -> tuple[tuple, bool, np.dtype]:
    """Shape, Fortran order and dtype from an open ``.npy`` stream."""
    version = np.lib.format.read_magic(f)
    if version == (1, 0):
        return np.lib.format.read_array_header_1_0(f)
    return np.lib.format.read_array_header_2_0(f)


class StoredArray(NamedTuple):
    """A stack of arrays in an archive; ``start`` is null where its rows cannot be read on their own."""
    rows: int
    shape: list
    dtype: str
    start: int | None


def stored_array(fh, name: str) -> StoredArray:
    """Where the rows of the array member ``name`` lie."""
    entry = next((m for m in zip_directory(fh) if m.member == name), None)
    if entry is None:
        raise KeyError(name)
    if entry.method == zipfile.ZIP_STORED:
        start = member_start(fh, entry.offset)
        fh.seek(start)
        shape, fortran, dtype = array_header(fh)
        return StoredArray(shape[0], list(shape[1:]), dtype.str, None if fortran else fh.tell())
    with zipfile.ZipFile(fh) as z, z.open(name) as f:
        shape, _, dtype = array_header(f)
    return StoredArray(shape[0], list(shape[1:]), dtype.str, None)


def array_rows(fh, name: str, a: StoredArray, lo: int, hi: int, batch: int):
    """Rows ``lo`` to ``hi`` of a stack as ``(first row, block)``, ``batch`` at a time."""
    per = int(np.prod(a.shape)) if a.shape else 1
    dtype = np.dtype(a.dtype)

    def blocks(f):
        for s in range(lo, hi, batch):
            k = min(batch, hi - s)
            yield s, np.frombuffer(f.read(k * per * dtype.itemsize), dtype).reshape(k, per)

    if a.start is not None:
        fh.seek(a.start + lo * per * dtype.itemsize)
        yield from blocks(fh)
        return
    with zipfile.ZipFile(fh) as z, z.open(name) as f:  # compressed: from the beginning, one task per file
        _, fortran, _ = array_header(f)
        if not fortran:
            yield from blocks(f)
            return
    with zipfile.ZipFile(fh) as z, z.open(name) as f:  # columns first: no row lies in one piece
        whole = np.lib.format.read_array(f).reshape(a.rows, per)
    for s in range(lo, hi, batch):
        yield s, whole[s:min(hi, s + batch)]
