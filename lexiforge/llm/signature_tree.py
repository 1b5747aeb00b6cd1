"""Signature trees over sets of shingle hashes, and their dual traversal.

A tree holds sets in the order of its leaves. Each node keeps the OR of its
sets' bitmaps, the range of their sizes and the largest excess of a set's size
over its bits (what hash collisions hide). Two nodes are compared only if some
pair below them may overlap enough: their sizes must lie within the factor that
the similarity allows, and the bits that both have, plus the smaller excess,
bound the overlap of any pair.
"""

from __future__ import annotations

import numpy as np

BITS = 1024
LEAF = 32


def bitmap(ids: np.ndarray) -> np.ndarray:
    """The set's hashed bitmap as 64-bit words."""
    out = np.zeros(BITS // 64, np.uint64)
    place = ids % np.uint64(BITS)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class SignatureTree:
    """sets: sorted hashes; sizes: the whole sets' sizes, which may exceed the hashes given (those that no other set can have)."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, places: np.ndarray):
        first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        order = np.lexsort((first, sizes))  # near copies have about the same size and often the same least hash
        self.sets = [sets[i] for i in order]
        self.sizes, self.places = sizes[order].astype(np.int64), places[order]
        self.bits = np.stack([bitmap(s) for s in self.sets]) if sets else np.zeros((0, BITS // 64), np.uint64)
        self.excess = np.array([len(s) for s in self.sets], np.int64) - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}

    def __len__(self) -> int:
        return len(self.sets)

    def node(self, a: int, b: int) -> tuple[np.ndarray, int, int, int]:
        """(OR of bitmaps, least size, largest size, largest excess) of the sets a to b."""
        found = self.nodes.get((a, b))
        if found is None:
            found = self.nodes[a, b] = (np.bitwise_or.reduce(self.bits[a:b]), int(self.sizes[a]), int(self.sizes[b - 1]), int(self.excess[a:b].max()))
        return found


class Groups:
    """Union-find over numbered sets."""

    def __init__(self, labels: np.ndarray):
        """labels: sets with the same label are together from the start."""
        _, first, which = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[which].tolist()

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)

    def roots(self, places: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, places.tolist()), np.int64, len(places))


def halves(a: int, b: int) -> list[tuple[int, int]]:
    middle = a + max(LEAF, (b - a + 1) // 2)
    return [(a, middle), (middle, b)] if b - a > LEAF else [(a, b)]


def enough(need: tuple[int, int], size_a, size_b):
    """The least overlap with which sets of these sizes link: 100 * i >= 75 * (a + b - i), for need = (75, 100)."""
    low, whole = need
    return -(-low * (size_a + size_b) // (whole + low))


def links(left: SignatureTree, right: SignatureTree, groups: Groups, need: tuple[int, int] = (75, 100)) -> list[tuple[int, int]]:
    """Pairs of places that link and that join two groups; all groups are joined in the end that any link joins.

    ``left`` and ``right`` may be the same tree. Pairs already in one group are
    passed over, for whole nodes at a time where all their sets are in one.
    """
    low, whole = need
    found: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return found
    same = left is right
    todo = [((0, len(left)), (0, len(right)))]
    while todo:
        (a, b), (c, d) = todo.pop()
        bits1, least1, most1, excess1 = left.node(a, b)
        bits2, least2, most2, excess2 = right.node(c, d)
        if whole * most1 < low * least2 or whole * most2 < low * least1:
            continue
        if int(np.bitwise_count(bits1 & bits2).sum()) + min(excess1, excess2) < enough(need, least1, least2):
            continue
        roots1, roots2 = groups.roots(left.places[a:b]), groups.roots(right.places[c:d])
        if roots1[0] == roots2[0] and (roots1 == roots1[0]).all() and (roots2 == roots1[0]).all():
            continue
        if b - a > LEAF or d - c > LEAF:
            todo += [(x, y) for x in halves(a, b) for y in halves(c, d) if not same or x <= y]
            continue
        both = np.bitwise_count(left.bits[a:b, None, :] & right.bits[None, c:d, :]).sum(2, dtype=np.int64)
        bound = both + np.minimum(left.excess[a:b, None], right.excess[None, c:d])
        size1, size2 = left.sizes[a:b, None], right.sizes[None, c:d]
        may = (bound >= enough(need, size1, size2)) & (whole * size1 >= low * size2) & (whole * size2 >= low * size1) & (roots1[:, None] != roots2[None, :])
        if same and a == c:
            may = np.triu(may, 1)
        for i, j in zip(*(x.tolist() for x in np.nonzero(may))):
            p, q = int(left.places[a + i]), int(right.places[c + j])
            if groups.root(p) == groups.root(q):
                continue
            if overlap(left.sets[a + i], right.sets[c + j]) >= enough(need, int(left.sizes[a + i]), int(right.sizes[c + j])):
                groups.join(p, q)
                found.append((p, q))
    return found
