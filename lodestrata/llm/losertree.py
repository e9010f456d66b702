"""Sorted runs of byte strings: front coding, and a loser-tree merge that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(x), len(y)) - known
    a, b = x[known : known + n], y[known : known + n]
    if a == b:
        return known + n
    return known + n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def front_coded(keys: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(length of the prefix shared with the key before, rest) for sorted keys."""
    before = b""
    for key in keys:
        n = common_prefix(before, key)
        yield n, key[n:]
        before = key


def decoded(coded: Iterable[tuple[int, bytes, Any]]) -> Iterator[tuple[int, bytes, Any]]:
    """(shared length, key, payload) from (shared length, rest, payload)."""
    before = b""
    for n, rest, payload in coded:
        before = before[:n] + rest
        yield n, before, payload


def merged(runs: list[Iterator[tuple[int, bytes, Any]]]) -> Iterator[tuple[int, bytes, Any]]:
    """One sorted run from many, each of (length shared with the run's key before, key, payload).

    Every waiting head keeps the length of its prefix shared with the last key given out. Of two heads the one that
    shares more is less, without a look at a byte; only heads that share equally much are compared, from there on.
    Equal keys come in the order of their runs.
    """
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    keys = [h and h[1] for h in heads]
    loads = [h and h[2] for h in heads]
    shared = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether head a is given out before b; the loser's shared length becomes that with the winner."""
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = common_prefix(x, y, shared[a])
        first = (x < y) if n < min(len(x), len(y)) or len(x) != len(y) else a < b
        shared[b if first else a] = n
        return first

    losers = [-1] * (2 * k)
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        won = beats(a, b)
        winners[node], losers[node] = (a, b) if won else (b, a)
    top = winners[1] if k > 1 else 0
    while keys[top] is not None:
        yield shared[top], keys[top], loads[top]
        head = next(runs[top], None)
        if head is None:
            keys[top] = loads[top] = None
        else:
            shared[top], keys[top], loads[top] = head
        node = (top + k) // 2
        while node:
            other = losers[node]
            if beats(other, top):
                losers[node], top = top, other
            node //= 2
