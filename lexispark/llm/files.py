"""Array files in the shared folder, opened by Arrow's file systems and memory-mapped by workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_MAPPED: dict[str, np.ndarray] = {}


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a temporary name, then move it: a reader never sees part of a file."""
    filesystem, path = open_folder(folder)
    filesystem.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(array.dtype), "fortran_order": False, "shape": array.shape})
    with filesystem.open_output_stream(temporary, compression=None) as out:
        out.write(head.getvalue())
        for i in range(0, len(array), 1 << 20):
            out.write(array[i : i + (1 << 20)].tobytes())
    filesystem.move(temporary, f"{path}/{name}.npy")


def mapped(folder: str, name: str) -> np.ndarray:
    """A memory map of an array file; a file of a remote store is first copied to the worker's temporary folder."""
    key = f"{folder}/{name}"
    if key not in _MAPPED:
        filesystem, path = open_folder(folder)
        local = f"{path}/{name}.npy"
        if not isinstance(filesystem, fs.LocalFileSystem):
            local = os.path.join(tempfile.mkdtemp(prefix="lexispark-"), f"{name}.npy")
            fs.copy_files(f"{path}/{name}.npy", local, source_filesystem=filesystem, destination_filesystem=fs.LocalFileSystem())
        _MAPPED[key] = np.load(local, mmap_mode="r")
    return _MAPPED[key]


def listed(folder: str) -> set[str]:
    """Names of the arrays stored in a folder, without their last part (-key)."""
    filesystem, path = open_folder(folder)
    found = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.base_name.removesuffix("-key.npy") for f in found if f.base_name.endswith("-key.npy") and not f.base_name.startswith(".")}
