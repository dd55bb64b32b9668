"""Signature trees over sets: dual traversal with bounds on the overlap.

A node holds the OR of its sets' token bitmaps, the range of their sizes and the
fewest bits that any of them sets.  Two sets A and B link when
``100 |A & B| >= share |A | B|``, so ``(100 + share) |A & B| >= share (|A| + |B|)``.
"""

import numpy as np

FANOUT = 8


def bitmap(tokens: np.ndarray, n_bytes: int) -> np.ndarray:
    """One bit for each token hash; ``n_bytes`` is a power of two."""
    bit = (tokens >> np.uint64(20)) & np.uint64(n_bytes * 8 - 1)
    out = np.zeros(n_bytes * 8, bool)
    out[bit] = True
    return np.packbits(out)


def folded(bits: bytes, n_bytes: int) -> np.ndarray:
    """A bitmap as it would be with fewer bytes."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > n_bytes:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


class Tree:
    """Levels of nodes, leaves first; leaves are in order of (group, size)."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((sizes, group))
        words = np.ascontiguousarray(bits[self.order]).view(np.uint64)
        n, g = sizes[self.order].astype(np.int64), group[self.order]
        self.levels = [(words, n, n, np.bitwise_count(words).sum(1, dtype=np.int64), g, g)]
        while len(self.levels[-1][1]) > 1:
            w, lo, hi, few, g_lo, g_hi = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(w, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(few, at), np.minimum.reduceat(g_lo, at), np.maximum.reduceat(g_hi, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
        """Which node pairs may hold a pair of sets that link and are of different groups."""
        w, lo, hi, few, g_lo, g_hi = self.levels[level]
        ok = (100 * hi[i] >= share * lo[j]) & (100 * hi[j] >= share * lo[i]) & ~((g_lo[i] == g_hi[i]) & (g_lo[j] == g_hi[j]) & (g_lo[i] == g_lo[j]))
        k = np.flatnonzero(ok)
        i, j = i[k], j[k]
        common = np.bitwise_count(w[i] & w[j]).sum(1, dtype=np.int64)
        # bits that a set has beyond the common ones are tokens that the other lacks
        most = 100 + share
        fits = most * (few[i] - common) <= 100 * hi[i] - share * lo[j]
        fits &= most * (few[j] - common) <= 100 * hi[j] - share * lo[i]
        ok[k] = fits
        return ok

    def pairs(self, share: int, chunk: int = 1 << 15):
        """Arrays (i, j) of positions that may link, by depth-first dual traversal."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            keep = self.possible(level, i, j, share) if level else self.possible(0, i, j, share) & (i < j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if not level:
                yield self.order[i], self.order[j]
                continue
            below = len(self.levels[level - 1][1])
            step = np.arange(FANOUT)
            a = (i[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
            b = (j[:, None, None] * FANOUT + step[None, None, :] + 0 * step[None, :, None]).ravel()
            keep = (a <= b) & (b < below) & (a < below)
            a, b = a[keep], b[keep]
            for s in range(0, len(a), chunk):
                stack.append((level - 1, a[s : s + chunk], b[s : s + chunk]))


def may_link(n: int, bits: bytes, m: int, other: bytes, share: int) -> bool:
    """The bound of the tree for two single sets."""
    if 100 * n < share * m or 100 * m < share * n:
        return False
    a, b = int.from_bytes(bits), int.from_bytes(other)
    common, most = (a & b).bit_count(), 100 + share
    return most * (a.bit_count() - common) <= 100 * n - share * m and most * (b.bit_count() - common) <= 100 * m - share * n


def find(parent: list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(sets: list[np.ndarray], share: int, n_bytes: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: pairs (i, j) that link.

    Pairs already in one component, or from the start in one ``group``, are passed
    over.  The sets that are left with candidates are counted exactly, each against
    all others by their shared tokens.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    group = np.arange(m) if group is None else group
    first: dict = {}
    parent, out = [first.setdefault(g, k) for k, g in enumerate(group.tolist())], []
    post = None
    if m <= FANOUT // 2:  # less than one node
        for x in range(m):
            for y in range(x):
                a, b, n = find(parent, x), find(parent, y), sizes[x] + sizes[y]
                if a != b and 100 * min(sizes[x], sizes[y]) >= share * max(sizes[x], sizes[y]) and (100 + share) * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= share * n:
                    parent[max(a, b)] = min(a, b)
                    out.append((x, y))
        return out
    tree = Tree(np.stack([bitmap(s, n_bytes) for s in sets]), sizes, group)
    for i, j in tree.pairs(share):
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True])
        for s, e in zip(cuts[:-1], cuts[1:]):
            x = int(i[s])
            ys = [y for y in j[s:e].tolist() if find(parent, y) != find(parent, x)]
            if not ys:
                continue
            if len(ys) < 3:
                counts = {y: len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in ys}
            else:
                if post is None:
                    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
                    owner = np.repeat(np.arange(m), sizes)
                    order = np.argsort(ids, kind="stable")
                    starts = np.searchsorted(ids[order], np.arange(ids.max() + 2))
                    post = ids, np.r_[0, np.cumsum(sizes)], owner[order], starts
                ids, at, holders, starts = post
                own = ids[at[x] : at[x + 1]]
                lo, n = starts[own], starts[own + 1] - starts[own]
                spread = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                counts = np.bincount(holders[spread], minlength=m)
            for y in ys:
                a, b = find(parent, x), find(parent, y)
                if a != b and (100 + share) * counts[y] >= share * (sizes[x] + sizes[y]):
                    parent[max(a, b)] = min(a, b)
                    out.append((x, y))
    return out
