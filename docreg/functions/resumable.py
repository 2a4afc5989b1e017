"""SHA-256 that stops after any byte and goes on in another task."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools

# Size of OpenSSL's SHA256_CTX, which holds everything between two calls and no pointer.
_CONTEXT = 112


@functools.cache
def _crypto() -> ctypes.CDLL:
    """The OpenSSL that Python's own hashlib is linked with."""
    import _hashlib

    lib = ctypes.CDLL(getattr(_hashlib, "__file__", None) or ctypes.util.find_library("crypto"))
    lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    return lib


class Sha256:
    """``state`` of one object, a few bytes, starts another behind the same text."""

    def __init__(self, state: bytes | None = None):
        self._context = ctypes.create_string_buffer(state or b"", _CONTEXT)
        if state is None:
            _crypto().SHA256_Init(self._context)

    @property
    def state(self) -> bytes:
        return self._context.raw

    def update(self, data: bytes) -> None:
        _crypto().SHA256_Update(self._context, data, len(data))

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state, _CONTEXT)
        _crypto().SHA256_Final(out, last)
        return out.raw.hex()
