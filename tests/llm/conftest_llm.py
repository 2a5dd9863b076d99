"""Helpers that the tests of this folder import."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def by_hand_components(n, edges):
    """The least member of each of n nodes' components."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
