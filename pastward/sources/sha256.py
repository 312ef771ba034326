"""SHA-256 that one task begins and another goes on with."""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa

WORDS = 28  # of 32 bits in SHA256_CTX of openssl/sha.h: 8 of the hash, 2 of the length, 16 of an open block, 2 counts


@cache
def _functions() -> tuple | None:
    """OpenSSL's ``SHA256_Init``, ``SHA256_Update`` and ``SHA256_Final``, from the library that ``hashlib`` runs on."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        init, update, final = library.SHA256_Init, library.SHA256_Update, library.SHA256_Final
    except (ImportError, OSError, AttributeError):
        return None
    init.argtypes = [ctypes.c_void_p]
    update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
    final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    return init, update, final


def resumable() -> bool:
    """Whether this Python's OpenSSL has these functions (they are deprecated since 3.0)."""
    return _functions() is not None


class Sha256:
    """A digest like ``hashlib.sha256()`` whose state can be taken out as bytes; ``hashlib`` does not give it."""

    def __init__(self, state: bytes | None = None):
        found = _functions()
        if found is None:
            raise RuntimeError("the OpenSSL of this Python has no SHA256_Init, SHA256_Update and SHA256_Final")
        self._init, self._update, self._final = found
        self._context = (ctypes.c_uint32 * WORDS)()
        if state is None:
            self._init(self._context)
        else:
            if len(state) != 4 * WORDS:
                raise ValueError(f"a state has {4 * WORDS} bytes, not {len(state)}")
            ctypes.memmove(self._context, state, len(state))

    def update(self, data: bytes | pa.Buffer) -> None:
        held = pa.py_buffer(data)
        self._update(self._context, held.address, held.size)

    def state(self) -> bytes:
        return bytes(self._context)

    def hexdigest(self) -> str:
        rest, out = type(self._context).from_buffer_copy(self._context), ctypes.create_string_buffer(32)
        self._final(out, rest)
        return out.raw.hex()
