"""Sorted runs of suffixes: front coding, and merging by loser trees that keep common prefix lengths."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    low, high = start, most
    while high - low > 8:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    while a[low] == b[low]:
        low += 1
    return low


def front_code(suffixes: list[bytes]) -> tuple[bytes, list[int], bytes]:
    """Sorted suffixes as the lengths they share with the one before, the lengths of the rests, and the rests."""
    shared, rests, before = bytearray(), [], b""
    for suffix in suffixes:
        same = common_prefix(before, suffix)
        shared.append(same)
        rests.append(suffix[same:])
        before = suffix
    return bytes(shared), [len(r) for r in rests], b"".join(rests)


def front_decode(shared: bytes, lengths: list[int], rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared length, suffix) of every suffix, in order."""
    at, before = 0, b""
    for same, length in zip(shared, lengths, strict=True):
        before = before[:same] + rests[at : at + length]
        at += length
        yield same, before


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Merge sorted front-coded runs: (run, prefix shared with the suffix merged before, suffix).

    A loser tree. Every waiting suffix carries the length it shares with the last one that passed its node; of two
    that both share with it, the one that shares more is smaller, and only equal lengths are compared on, from there.
    """
    if not runs:
        return
    size = 1
    while size < len(runs):
        size *= 2
    # A waiting suffix is (shared with the last winner, suffix, run); None stands for an exhausted run.
    heads: list[tuple[int, bytes, int] | None] = [None] * size
    for r, run in enumerate(runs):
        first = next(run, None)
        heads[r] = None if first is None else (0, first[1], r)

    def play(a, b):
        """(winner, loser); the loser's shared length is then against the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        same = common_prefix(a[1], b[1], a[0])
        if a[1][same : same + 1] <= b[1][same : same + 1]:
            return a, (same, b[1], b[2])
        return b, (same, a[1], a[2])

    losers: list[tuple[int, bytes, int] | None] = [None] * size
    winners = [None] * size + heads
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    while winner is not None:
        shared, suffix, run = winner
        yield run, shared, suffix
        # Front coding gives what the next suffix of this run shares with the winner.
        following = next(runs[run], None)
        winner = None if following is None else (following[0], following[1], run)
        node = (run + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
