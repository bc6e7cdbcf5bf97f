"""Arrays in one file that workers map into memory, so that all workers of a machine share its pages."""

from __future__ import annotations

import json

import numpy as np


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a line of JSON that says what stands where, then the arrays, each from a multiple of 64 bytes."""
    head, body = {}, bytearray()
    for name, x in arrays.items():
        body += b"\0" * (-len(body) % 64)
        head[name] = [x.dtype.str, list(x.shape), len(body)]
        body += np.ascontiguousarray(x).tobytes()
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    return line + bytes(body)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        line = f.readline()
    return {
        name: np.memmap(path, dtype=dtype, mode="r", offset=len(line) + at, shape=tuple(shape)) if 0 not in shape else np.zeros(shape, dtype)
        for name, (dtype, shape, at) in json.loads(line).items()
    }
