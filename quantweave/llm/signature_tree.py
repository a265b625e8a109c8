"""All links of a block of token sets, by a tree of bitmap signatures.

A leaf holds a run of sets in order of size; every node holds the OR of its
sets' bitmaps and their least and greatest size. Two nodes are taken together
from the root down. A pair of nodes goes no further when the sizes are too far
apart, when the bits that both have allow no overlap large enough, or when all
their sets are in one component already.
"""

from fractions import Fraction

import numpy as np

from .components import relabel

LEAF, FAN = 32, 4


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) else 0


def similar(common, a, b, least: Fraction):
    """Whether sets of a and b elements with `common` in both reach the Jaccard similarity `least`."""
    return common * (least.numerator + least.denominator) >= least.numerator * (a + b)


class _Tree:
    """Over sets of n elements, in order of n, with these bitmaps of 64-bit words."""

    def __init__(self, n: np.ndarray, maps: np.ndarray):
        self.n, self.maps = n, maps
        #: Elements that share a bit with another: no bitmap shows them.
        self.hidden = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        level = [(i, min(i + LEAF, len(n)), ()) for i in range(0, len(n), LEAF)]
        while len(level) > 1:
            level = [(g[0][0], g[-1][1], tuple(g)) for g in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = self._node(level[0])

    def _node(self, spec):
        lo, hi, below = spec
        kids = [self._node(x) for x in below]
        union = np.bitwise_or.reduce([k["or"] for k in kids]) if kids else np.bitwise_or.reduce(self.maps[lo:hi], axis=0)
        return {"lo": lo, "hi": hi, "kids": kids, "or": union, "least": int(self.n[lo:hi].min()), "most": int(self.n[lo:hi].max()), "hidden": int(self.hidden[lo:hi].max())}


def links(sets: list[np.ndarray], least: Fraction, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that are similar and that join all similar sets: a
    spanning forest of the similarity graph. With `cross`, a side (0 or 1) for
    each set, only pairs across sides count."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    bits = 1 << min(16, max(8, (8 * len(sets[-1]) - 1).bit_length()))
    maps = np.zeros((len(sets), bits), bool)
    for row, s in zip(maps, sets, strict=True):
        row[(s % np.uint64(bits)).astype(np.int64)] = True
    tree = _Tree(np.array([len(s) for s in sets], np.int64), np.packbits(maps, axis=1).view(np.uint64))
    true = lambda p, q: similar(overlap(sets[p], sets[q]), len(sets[p]), len(sets[q]), least)
    return _search(tree, order, np.arange(len(sets)), least, None if cross is None else cross[order], true)


def possible_links(n: np.ndarray, maps: np.ndarray, least: Fraction, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The same by bitmaps alone: a forest that joins all sets of which these do not rule out that they are similar."""
    order = np.argsort(n, kind="stable")
    tree = _Tree(n[order], maps[order])
    group, found, side = np.arange(len(n)), [], None if cross is None else cross[order]
    # most sets of a crowd are like its middle one
    mid = len(n) // 2
    top = np.bitwise_count(tree.maps & tree.maps[mid]).sum(1, dtype=np.int64) + np.minimum(tree.hidden, tree.hidden[mid])
    like = similar(np.minimum(top, np.minimum(tree.n, tree.n[mid])), tree.n, tree.n[mid], least)
    like[mid] = False
    if side is not None:
        like &= side != side[mid]
    near = np.flatnonzero(like)
    if len(near):
        found = [(int(order[mid]), int(order[q])) for q in near]
        group[near] = group[mid] = min(mid, int(near[0]))
    return found + _search(tree, order, group, least, side, lambda p, q: True)


def _search(tree: _Tree, order: np.ndarray, group: np.ndarray, least: Fraction, side: np.ndarray | None, true) -> list[tuple[int, int]]:
    """Pairs, by `order`, that `true` accepts and that join groups; `group`: labels of what is joined already."""
    found: list[tuple[int, int]] = []

    def pairs(x, y):
        i, j = np.arange(x["lo"], x["hi"]), np.arange(y["lo"], y["hi"])
        both = np.zeros((len(i), len(j)), np.int64)
        for w in range(0, tree.maps.shape[1], 64):
            both += np.bitwise_count(tree.maps[i, None, w : w + 64] & tree.maps[None, j, w : w + 64]).sum(2, dtype=np.int64)
        top = both + np.minimum(tree.hidden[i][:, None], tree.hidden[j][None])
        ok = similar(top, tree.n[i][:, None], tree.n[j][None], least) & (group[i][:, None] != group[j][None])
        if x is y:
            ok &= i[:, None] < j[None]
        if side is not None:
            ok &= side[i][:, None] != side[j][None]
        a, b = np.nonzero(ok)
        for p in np.argsort(-top[a, b], kind="stable"):
            p, q = int(i[a[p]]), int(j[b[p]])
            if group[p] != group[q] and true(p, q):
                relabel(group, p, q)
                found.append((int(order[p]), int(order[q])))

    stack = [(tree.root, tree.root)]
    while stack:
        x, y = stack.pop()
        # x has the smaller sets: the tree is in order of size
        if x["most"] * least.denominator < y["least"] * least.numerator:
            continue
        own = group[x["lo"]]
        if (group[x["lo"] : x["hi"]] == own).all() and (group[y["lo"] : y["hi"]] == own).all():
            continue
        if x is not y:
            top = int(np.bitwise_count(x["or"] & y["or"]).sum()) + min(x["hidden"], y["hidden"])
            if not similar(top, x["least"], y["least"], least):
                continue
        if not x["kids"] and not y["kids"]:
            pairs(x, y)
        elif x is y:
            kids = x["kids"]
            # equal nodes last on the stack, so that close sets meet first
            stack += [(a, b) for i, a in enumerate(kids) for b in kids[i + 1 :]] + [(a, a) for a in kids]
        elif y["kids"] and (not x["kids"] or y["hi"] - y["lo"] >= x["hi"] - x["lo"]):
            stack += [(x, b) for b in y["kids"]]
        else:
            stack += [(a, y) for a in x["kids"]]
    return found
