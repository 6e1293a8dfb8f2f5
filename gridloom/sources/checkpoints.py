"""Checkpoints of trained networks: zip archives of a pickled dictionary and one file a storage.

Only dictionaries of tensors are read.  Every other name in the pickle is refused, so that a file
cannot run code.  Files are read on the driver: weights are a model's, they do not grow with data.
"""

from __future__ import annotations

import collections
import io
import pickle
import zipfile

import numpy as np

from . import rasters

#: Names of storages in the format.
STORAGES = {
    "DoubleStorage": "f8",
    "FloatStorage": "f4",
    "HalfStorage": "f2",
    "LongStorage": "i8",
    "IntStorage": "i4",
    "ShortStorage": "i2",
    "CharStorage": "i1",
    "ByteStorage": "u1",
    "BoolStorage": "?",
}


def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
    """A copy of the part of a storage that a tensor shows."""
    size, stride = tuple(size), tuple(stride)
    if offset < 0 or min((*size, *stride), default=0) < 0 or len(size) != len(stride):
        raise ValueError("a tensor of negative size")
    last = offset + sum((n - 1) * s for n, s in zip(size, stride))
    if 0 not in size and last >= storage.size:
        raise ValueError("a tensor reaches beyond its storage")
    if 0 in size:
        return np.zeros(size, storage.dtype)
    return np.lib.stride_tricks.as_strided(storage[offset:], size, tuple(s * storage.itemsize for s in stride)).copy()


class _Storage:
    """Stands for a class of storages."""

    def __init__(self, code: str):
        self.code = code


class _Reader(pickle.Unpickler):
    def __init__(self, archive: zipfile.ZipFile, root: str):
        super().__init__(io.BytesIO(archive.read(f"{root}data.pkl")))
        self.archive, self.root, self.read = archive, root, {}
        order = f"{root}byteorder"
        self.order = ">" if order in archive.namelist() and archive.read(order).strip() == b"big" else "<"

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if module == "torch" and name in STORAGES:
            return _Storage(STORAGES[name])
        raise pickle.UnpicklingError(f"{module}.{name} is not read")

    def persistent_load(self, pid: tuple) -> np.ndarray:
        mark, kind, key, _, size = pid
        if mark != "storage" or not isinstance(kind, _Storage):
            raise pickle.UnpicklingError(f"{mark} is not read")
        if key not in self.read:
            held = np.frombuffer(self.archive.read(f"{self.root}data/{key}"), self.order + kind.code)
            if held.size < size:
                raise ValueError(f"storage {key} is cut short")
            self.read[key] = held.astype(held.dtype.newbyteorder("="), copy=False)
        return self.read[key]


def read(path: str) -> dict[str, np.ndarray]:
    """Names and arrays of a checkpoint, from any store that Arrow opens by path.

    A training state that holds the parameters under ``state_dict`` or ``model`` gives those.
    """
    with rasters.opened(path) as f, zipfile.ZipFile(f) as archive:
        pickled = [n for n in archive.namelist() if n == "data.pkl" or n.endswith("/data.pkl")]
        if len(pickled) != 1:
            raise ValueError(f"{path} is not a zipped checkpoint")
        got = _Reader(archive, pickled[0].removesuffix("data.pkl")).load()
    for key in ("state_dict", "model"):
        if isinstance(got, dict) and isinstance(got.get(key), dict):
            got = got[key]
    if not isinstance(got, dict) or not all(isinstance(v, np.ndarray) for v in got.values()):
        raise ValueError(f"{path} holds more than named tensors")
    return dict(got)
