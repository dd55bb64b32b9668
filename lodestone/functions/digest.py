"""md5 draws of many short texts at once, by arrays of 32-bit words."""

import math

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(k)) * 2**32) for k in range(1, 65)]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_LAST = 61  # steps of 64 after which the first word of the digest is known
AT_ONCE = 1 << 12  # pairs and
TOGETHER = 12  # replicates whose words stay near the processor


def first_word(words: dict[int, np.ndarray], bits: int, shape: tuple[int, ...]) -> np.ndarray:
    """The first four bytes of the md5 of texts, as numbers: what their first eight hexadecimal digits say.

    ``words`` are the little-endian words of the padded texts that are not zero in all of them, 56 bytes at
    most, each as far as it differs along ``shape``; ``bits`` is the length of a text.
    """
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for step in range(_LAST):
        turn, k = divmod(step, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif turn == 1:
            k = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif turn == 2:
            k = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            k = 7 * k % 16
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        constant = np.uint32((_SINES[step] + (bits if k == 14 else 0)) & 0xFFFFFFFF)
        t += words[k] + constant if k in words else constant
        shift = _SHIFTS[turn][step % 4]
        np.right_shift(t, np.uint32(32 - shift), out=u)
        t <<= np.uint32(shift)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += _START[0]
    return b.byteswap()


def decimals(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decimal texts of whole numbers, a row of bytes each, and their lengths."""
    text = numbers.astype(np.int64).astype("S20").view(np.uint8).reshape(len(numbers), 20)
    return text, (text != 0).sum(axis=1)


def draws(replicates: int, i: np.ndarray, j: np.ndarray, text: np.ndarray, length: np.ndarray):
    """For each replicate k from 0: numbers in [0, 1) from the md5 of ``k|i|j``, as ``uniform_md5`` has them.

    ``i`` and ``j`` are rows of ``text`` and ``length``, see ``decimals``.  Pairs are taken by the lengths of both numbers.
    """
    out = np.empty((replicates, len(i)))
    kind = length[i] * 32 + length[j]
    for x in np.unique(kind):
        some = np.flatnonzero(kind == x)
        first, second = divmod(int(x), 32)
        for at in range(0, len(some), AT_ONCE):
            own = some[at : at + AT_ONCE]
            one, other = text[i[own], :first], text[j[own], :second]
            for head in range(1, len(str(replicates - 1)) + 1):
                size = head + 2 + first + second
                raw = np.zeros((len(own), 4 * (size // 4 + 1)), np.uint8)
                raw[:, head] = raw[:, head + 1 + first] = ord("|")
                raw[:, head + 1 : head + 1 + first], raw[:, head + 2 + first : size], raw[:, size] = one, other, 128
                words = dict(enumerate(np.ascontiguousarray(raw.view("<u4").T)))
                every = range(10 ** (head - 1) if head > 1 else 0, min(10**head, replicates))
                for few in (every[k : k + TOGETHER] for k in range(0, len(every), TOGETHER)):
                    start = np.frombuffer(b"".join(str(k).encode().ljust(4 * -(-head // 4), b"\0") for k in few), "<u4").reshape(len(few), -1, 1)
                    changed = {w: start[:, w] + words[w] for w in range(start.shape[1])}
                    out[few.start : few.stop, own] = first_word(words | changed, 8 * size, (len(few), len(own)))
    out /= 4294967296.0
    return out
