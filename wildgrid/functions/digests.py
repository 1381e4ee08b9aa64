"""The first digits of md5 digests of many short texts at once, as uniform() in expr draws them one by one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Texts worked on at a time, so that they stay in the cache.
AT_ONCE = 1 << 13
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORDS = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_MIX = [lambda b, c, d: d ^ (b & (c ^ d)), lambda b, c, d: c ^ (d & (b ^ c)), lambda b, c, d: b ^ c ^ d, lambda b, c, d: c ^ (b | ~d)]


def _first_word(padded: np.ndarray) -> np.ndarray:
    """Of each padded text (rows of bytes, whole blocks) the first eight digits of its digest, as a number."""
    words = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(len(padded), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for block in range(0, len(words), 16):
        a, b, c, d = state
        for i in range(64):
            turn = _TURNS[i // 16][i % 4]
            f = _MIX[i // 16](b, c, d)
            f += a
            f += words[block + _WORDS[i // 16](i)]
            f += _SINES[i]
            a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
        state = [s + v for s, v in zip(state, (a, b, c, d))]
    return state[0].byteswap()


def heads(prefixes: Sequence[bytes], names: Sequence[bytes]) -> np.ndarray:
    """A row for each prefix, a column for each name: the first eight digits of the md5 of prefix and name, as a number."""
    out = np.empty((len(prefixes), len(names)), np.uint32)
    sizes, widths = np.array([len(p) for p in prefixes]), np.array([len(n) for n in names])
    for size in np.unique(sizes).tolist():
        rows, blocks = np.flatnonzero(sizes == size), (size + widths + 8) // 64 + 1
        for n in np.unique(blocks).tolist():
            columns = np.flatnonzero(blocks == n)
            made = np.zeros((len(columns), 64 * n), np.uint8)
            for one, j in zip(made, columns):
                end = size + len(names[j])
                one[size:end], one[end], one[-8:] = np.frombuffer(names[j], np.uint8), 0x80, np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
            step = max(1, AT_ONCE // len(columns))
            for at in np.split(rows, range(step, len(rows), step)):
                padded = np.repeat(made[None], len(at), axis=0)
                padded[:, :, :size] = np.frombuffer(b"".join(prefixes[i] for i in at), np.uint8).reshape(len(at), 1, size)
                out[np.ix_(at, columns)] = _first_word(padded.reshape(-1, 64 * n)).reshape(len(at), -1)
    return out


def pair_heads(prefix: bytes, lefts: np.ndarray, rights: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each text prefix|left|right the first eight digits of its md5, as a number; lefts and rights are arrays of bytes, i and j their places."""
    out = np.empty(len(i), np.uint32)
    a, b = np.strings.str_len(lefts)[i], np.strings.str_len(rights)[j]
    shape = a * (rights.itemsize + 1) + b
    left, right = (x.view(np.uint8).reshape(len(x), -1) for x in (np.ascontiguousarray(lefts), np.ascontiguousarray(rights)))
    front = np.frombuffer(prefix + b"|", np.uint8)
    for one in np.unique(shape).tolist():
        rows, (na, nb) = np.flatnonzero(shape == one), divmod(one, rights.itemsize + 1)
        at = len(front) + na + 1
        for part in np.split(rows, range(AT_ONCE, len(rows), AT_ONCE)):
            padded = np.zeros((len(part), 64 * ((at + nb + 8) // 64 + 1)), np.uint8)
            padded[:, : len(front)], padded[:, at - 1], padded[:, at + nb] = front, ord("|"), 0x80
            padded[:, len(front) : at - 1], padded[:, at : at + nb] = left[i[part], :na], right[j[part], :nb]
            padded[:, -8:] = np.frombuffer((8 * (at + nb)).to_bytes(8, "little"), np.uint8)
            out[part] = _first_word(padded)
    return out
