"""Cover trees over integer vectors and the dual-tree search for nearest centroids, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Up to this size of component, matrix products in doubles are exact for 64 components and more.
EXACT_DOUBLE = 1 << 21
PAIRS = 1 << 14  # pairs of vectors held against each other at once


class Tree(NamedTuple):
    """Points in the order of the tree; node i holds points start[i]:end[i] within radius[i] of the point center[i].

    A leaf has no children; the children of a node follow each other.
    """

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    center: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, exact integers."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT_DOUBLE:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((row - b) ** 2).sum(1) for row in a]) if len(a) else np.zeros((0, len(b)), np.int64)


def pair_squares(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distance of a[i] to b[j] for each pair, exact integers."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        here = slice(at, at + PAIRS)
        gap = a[i[here]] - b[j[here]]
        out[here] = np.einsum("ij,ij->i", gap, gap)
    return out


def cover_tree(points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """The tree over ``points`` and their order in it.

    A node of radius r is covered by balls of radius r / 2: its own center
    first, then the point farthest from all chosen ones until none is left, so
    that centers of a level are further than r / 2 apart.  Nodes of at most
    ``leaf`` points, and of equal points however many, are leaves.
    """
    distances = np.sqrt(squares(points, points))
    order = np.arange(len(points))
    nodes, radii = [[0, len(points), 0, 0, 0]], []
    for node in nodes:  # grows while it is walked
        start, end, center = node[:3]
        own = order[start:end]
        near = distances[center, own]
        radius = near.max()
        radii.append(radius)
        if end - start <= leaf or radius == 0:
            continue
        chosen, owner = [center], np.zeros(len(own), np.int64)
        while near.max() > radius / 2:
            far = own[near.argmax()]
            gap = distances[far, own]
            closer = gap < near
            owner[closer] = len(chosen)
            near = np.where(closer, gap, near)
            chosen.append(far)
        order[start:end] = own[np.argsort(owner, kind="stable")]
        node[3:] = len(nodes), len(chosen)
        for point, size in zip(chosen, np.bincount(owner, minlength=len(chosen)), strict=True):
            nodes.append([start, start + int(size), int(point), 0, 0])
            start += int(size)
    table = np.array(nodes, np.int64)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    return Tree(points[order], table[:, 0], table[:, 1], place[table[:, 2]], table[:, 3], table[:, 4], np.array(radii)), order


def _groups(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and the run of each entry."""
    fresh = np.r_[True, v[1:] != v[:-1]]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _each(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges start:start+size, the range and the entry of each member."""
    of = np.repeat(np.arange(len(size)), size)
    return of, start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


class Centroids:
    """Numbered centroids and their cover tree; of equal ones only the smallest number can be nearest."""

    def __init__(self, centroids: list[list[int]]):
        points = np.array(centroids, np.int64)
        self.tree, order = cover_tree(points, 1)
        starts = self.tree.start[self.tree.children == 0]
        ends = self.tree.end[self.tree.children == 0]
        #: of each leaf's first point: the centroid's number
        self.number = np.zeros(len(points), np.int64)
        for s, e in zip(starts, ends, strict=True):
            self.number[s] = order[s:e].min()


def nearest(block: Tree, centroids: Centroids) -> np.ndarray:
    """The nearest centroid of each point of the block, the smaller number in ties.

    Pairs of nodes go down both trees together.  A centroid node goes as soon
    as all its centroids are further from all points of the vector node than
    some other centroid; a vector node left with one centroid is done whole;
    leaves are compared point by point in integers.
    """
    tree = centroids.tree
    found = np.empty(len(block.points), np.int64)
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        gap = np.sqrt(pair_squares(block.points, block.center[v], tree.points, tree.center[c]))
        reach = block.radius[v] + tree.radius[c]
        first, group = _groups(v)
        # bounds are doubles of exact squares: leave room for their rounding
        most = np.minimum.reduceat(gap + reach, first) * (1 + 1e-9) + 1e-6
        stay = gap - reach <= most[group]
        v, c = v[stay], c[stay]
        first, group = _groups(v)
        node, count = v[first], np.diff(np.r_[first, len(v)])
        widest = np.maximum.reduceat(tree.radius[c], first)
        leaf = block.children[node] == 0
        whole = (count == 1) & (widest == 0)
        open_c = ~whole & (widest > 0) & (leaf | (widest >= block.radius[node]))
        exact = ~whole & ~open_c & leaf
        open_v = ~whole & ~open_c & ~leaf
        of, points = _each(block.start[node[whole]], (block.end - block.start)[node[whole]])
        found[points] = centroids.number[tree.start[c[first[whole]]]][of]
        if exact.any():
            _compare(block, centroids, v[exact[group]], c[exact[group]], found)
        parts_v, parts_c = [], []
        here = open_c[group] & (tree.children[c] > 0)
        of, entry = _each(tree.child[c[here]], tree.children[c[here]])
        parts_v += [v[here][of], v[open_c[group] & (tree.children[c] == 0)]]
        parts_c += [entry, c[open_c[group] & (tree.children[c] == 0)]]
        here = open_v[group]
        of, entry = _each(block.child[v[here]], block.children[v[here]])
        v, c = np.concatenate([*parts_v, entry]), np.concatenate([*parts_c, c[here][of]])
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
    return found


def _compare(block: Tree, centroids: Centroids, v: np.ndarray, c: np.ndarray, found: np.ndarray) -> None:
    """Leaf against leaf: all points of each vector leaf with its candidates."""
    of, point = _each(block.start[v], (block.end - block.start)[v])
    at = centroids.tree.start[c[of]]
    order = np.argsort(point, kind="stable")
    point, at = point[order], at[order]
    gap = pair_squares(block.points, point, centroids.tree.points, at)
    first, group = _groups(point)
    least = np.minimum.reduceat(gap, first)
    number = np.where(gap == least[group], centroids.number[at], np.iinfo(np.int64).max)
    found[point[first]] = np.minimum.reduceat(number, first)
