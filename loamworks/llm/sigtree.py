"""Signature trees over token sets: which pairs of documents can overlap enough, by dual traversal.

A document's signature is a bitmap of its hashed tokens, as wide as the power of two its number of tokens needs. A node holds the
bitmaps of its documents combined with OR, the range of their sizes, and the most tokens that share bits in one of them (``spare``).
Two documents share at most the bits they have in common plus what is spare in one of them, and two nodes at most as much as their
combined bitmaps say, so a pair of nodes whose bound falls short of what their smallest sizes would need is cut off with all pairs
below it. Pairs of nodes within one component are cut off as well: links are wanted up to connectivity only.

The bounds never cut a pair that links. All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 4


class Threshold:
    """Sets of a and b tokens link if den * shared >= num * (a + b - shared)."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def links(self, shared: int, sizes: int) -> bool:
        return (self.num + self.den) * shared >= self.num * sizes

    def sizes_fit(self, a: int, b: int) -> bool:
        """Whether a set of a tokens could link with one of b at all; for ranges, give the greater end of one and the lesser of the other."""
        return self.den * a >= self.num * b

    def prefix(self, n: int) -> int:
        """So many of a set's first tokens, in any order common to all sets, hold one that each partner's first tokens hold too."""
        return n - -(-self.num * n // self.den) + 1


def width(n: int, times: int = 1) -> int:
    """Bits of the signature of n tokens: a power of two."""
    return times << max(6, (n - 1).bit_length())


def signature(hashes: np.ndarray, bits: int) -> bytes:
    on = np.zeros(bits, bool)
    on[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def folded(bits: int, wide: int) -> int:
    """A signature of half the width."""
    half = wide // 2
    return bits >> half | bits & (1 << half) - 1


class Node:
    __slots__ = ("low", "high", "bits", "spare", "kids", "at", "height", "one")

    def __init__(self, low: int, high: int, bits: int, spare: int, kids: list | None, at: int, height: int) -> None:
        self.low, self.high, self.bits, self.spare, self.kids, self.at, self.height = low, high, bits, spare, kids, at, height
        self.one = kids is None  # all below is in one component


def tree(items: list[tuple[int, int, int]], fanout: int = FANOUT) -> Node | None:
    """Of (size, signature, place): neighbours in size, then in signature, share a parent."""
    level = [Node(n, n, bits, n - bits.bit_count(), None, at, 0) for n, bits, at in sorted(items)]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), fanout):
            kids = level[i : i + fanout]
            bits = 0
            for k in kids:
                bits |= k.bits
            above.append(Node(kids[0].low, max(k.high for k in kids), bits, max(k.spare for k in kids), kids, kids[0].at, kids[0].height + 1))
        level = above
    return level[0] if level else None


class Sets:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def traverse(x: Node | None, y: Node | None, rule: Threshold, sets: Sets, link: Callable[[int, int], bool], found: list[tuple[int, int]]) -> None:
    """Visit the pairs of leaves below x and y that can link and are not connected yet; those that do are united and put in ``found``."""
    if x is None or y is None:
        return
    find = sets.find

    def one(node: Node) -> bool:
        if not node.one and all(map(one, node.kids)):
            top = find(node.at)
            node.one = all(find(k.at) == top for k in node.kids)
        return node.one

    def visit(x: Node, y: Node) -> None:
        if x is y:
            if x.kids is not None and not x.one:
                for k in x.kids:
                    visit(k, k)
                for i, k in enumerate(x.kids):
                    for other in x.kids[i + 1 :]:
                        visit(k, other)
                one(x)
            return
        if x.one and y.one and find(x.at) == find(y.at):
            return
        if not (rule.sizes_fit(x.high, y.low) and rule.sizes_fit(y.high, x.low)):
            return
        most = min((x.bits & y.bits).bit_count() + min(x.spare, y.spare), x.high, y.high)
        if not rule.links(most, x.low + y.low):
            return
        if x.kids is None and y.kids is None:
            if x.at != y.at and link(x.at, y.at) and sets.union(x.at, y.at):
                found.append((x.at, y.at))
        elif y.kids is None or (x.kids is not None and x.height >= y.height):
            for k in x.kids:
                visit(k, y)
        else:
            for k in y.kids:
                visit(x, k)

    visit(x, y)


def join(items: list[tuple[int, int, int]], left: list[int] | None, right: list[int] | None, rule: Threshold, sets: Sets, link: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links of a block, up to connectivity. ``items`` are (size, signature, width) by place; ``left`` and ``right`` the places to
    compare with each other, or None for all places among themselves.

    Sets that link differ by less than a factor of two in size, so signatures of one width meet, and those of neighbouring widths,
    the wider one folded."""
    found: list[tuple[int, int]] = []
    sides = [range(len(items))] if left is None else [left, right]
    by: list[dict[int, list[int]]] = []
    for side in sides:
        classes: dict[int, list[int]] = {}
        for at in side:
            classes.setdefault(items[at][2], []).append(at)
        by.append(classes)
    if left is None:
        by.append(by[0])

    def own(classes: dict[int, list[int]], w: int) -> Node | None:
        return tree([(items[at][0], items[at][1], at) for at in classes.get(w, ())])

    def lowered(classes: dict[int, list[int]], w: int) -> Node | None:
        return tree([(items[at][0], folded(items[at][1], 2 * w), at) for at in classes.get(2 * w, ())])

    for w in sorted(set(by[0]) | set(by[1])):
        x = own(by[0], w)
        y = x if left is None else own(by[1], w)
        traverse(x, y, rule, sets, link, found)
        if x is not None and 2 * w in by[1]:
            traverse(x, lowered(by[1], w), rule, sets, link, found)
        if left is not None and y is not None and 2 * w in by[0]:
            traverse(lowered(by[0], w), y, rule, sets, link, found)
    return found
