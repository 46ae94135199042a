"""Words of letters and digits in UTF-8: runs of 0-9, a-z (A-Z lower-cased) and all code points beyond ASCII."""

from __future__ import annotations

import numpy as np

_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at a time, so that a long text's words are not all held as objects of their own by callers that only count.
STRETCH = 1 << 20


def folded(text: bytes) -> bytes:
    """The text, byte for byte, with A-Z lower-cased and a blank for each byte outside words."""
    return text.translate(_FOLD)


def words(line: bytes) -> list[bytes]:
    return line.split()


def stretches(line: bytes):
    """A folded text in parts of about ``STRETCH``, cut at blanks."""
    at = 0
    while at < len(line):
        stop = line.find(b" ", at + STRETCH)
        stop = len(line) if stop < 0 else stop
        yield line[at:stop]
        at = stop


def places(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of a folded text's words."""
    letter = (np.frombuffer(line, np.uint8) != 32).view(np.int8)
    edge = np.diff(np.concatenate([[0], letter, [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
