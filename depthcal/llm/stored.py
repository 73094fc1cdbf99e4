"""Files of arrays in the shared folder: mapped into memory from a mount, read from any other store."""

from __future__ import annotations

import os
from collections import OrderedDict

import numpy as np

from .common import local_path, open_uri, rename_uri

#: Bytes of pieces that a worker keeps of a store that can't be mapped.
KEPT_BYTES = 256 << 20

_open: OrderedDict[str, tuple[list[int], list[np.ndarray], int]] = OrderedDict()


def save(stream, arrays: list[np.ndarray], numbers: list[int]) -> None:
    """Arrays one after the other on 8-byte bounds behind a table of their kinds and lengths."""
    kinds = "".join(f"{a.dtype.str}:{len(a)};" for a in arrays)
    head = f"{','.join(map(str, numbers))}|{kinds}".encode()
    head += b" " * (-(len(head) + 8) % 8)
    stream.write(np.array([len(head)], "<u8").tobytes() + head)
    for a in arrays:
        raw = a.tobytes()
        stream.write(raw + b"\0" * (-len(raw) % 8))


def publish(path: str, arrays: list[np.ndarray], numbers: list[int]) -> None:
    """Write under a passing name, then rename: a repeated task replaces its own file."""
    passing = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open_uri(passing, "wb") as stream:
        save(stream, arrays, numbers)
    rename_uri(passing, path)


def _mapped(uri: str) -> bool:
    return "://" not in uri or uri.startswith("file:")


def load(uri: str) -> tuple[list[int], list[np.ndarray]]:
    """The numbers and the arrays of a file: mapped from a mount, read whole from another store."""
    if _mapped(uri):
        data = np.memmap(local_path(uri), np.uint8, "r")
    else:
        with open_uri(uri, "rb") as stream:
            data = np.frombuffer(stream.read(), np.uint8)
    size = int(data[:8].view("<u8")[0])
    numbers, _, kinds = bytes(data[8:8 + size]).decode().strip().partition("|")
    at, arrays = 8 + size, []
    for item in kinds.split(";")[:-1]:
        kind, _, n = item.partition(":")
        length = int(n) * np.dtype(kind).itemsize
        arrays.append(np.frombuffer(data, kind, int(n), at) if int(n) else np.zeros(0, kind))
        at += length + (-length % 8)
    return [int(x) for x in numbers.split(",")], arrays


def load_cached(uri: str) -> tuple[list[int], list[np.ndarray]]:
    """As :func:`load`, kept open by the worker; of files that were read, at most KEPT_BYTES."""
    if uri not in _open:
        numbers, arrays = load(uri)
        _open[uri] = numbers, arrays, 0 if _mapped(uri) else sum(a.nbytes for a in arrays)
    _open.move_to_end(uri)
    while len(_open) > 1 and (sum(x[2] for x in _open.values()) > KEPT_BYTES or len(_open) > 4096):
        _open.popitem(last=False)
    return _open[uri][:2]
