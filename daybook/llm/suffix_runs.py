"""Sorted, front-coded string runs and the loser tree that merges them by common prefix lengths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator



def first_difference(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be ``at`` or more; eight bytes a step."""
    n = min(len(a), len(b))
    while at < n:
        x = int.from_bytes(a[at : at + 8].ljust(8, b"\0"), "big") ^ int.from_bytes(b[at : at + 8].ljust(8, b"\0"), "big")
        if x:
            return min(n, at + ((64 - x.bit_length()) >> 3))
        at += 8
    return n


def front_code(items: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """A sorted run as (prefix lengths, string lengths, tails); strings have at most 255 bytes."""
    lcps, tails, last = bytearray(), [], b""
    for s in items:
        p = first_difference(last, s, 0)
        lcps.append(p)
        tails.append(s[p:])
        last = s
    return bytes(lcps), bytes(map(len, items)), b"".join(tails)


def decode(lcps: bytes, sizes: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """(prefix shared with the string before, string) of a front-coded run."""
    last, at = b"", 0
    for p, n in zip(lcps, sizes, strict=True):
        end = at + n - p
        last = last[:p] + tails[at:end]
        at = end
        yield p, last


def merge(runs: list[Iterable[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted runs: (prefix shared with the string put out before, string, run).

    ``known[r]`` is the prefix that the head of run r shares with the last winner.  A head that shares more is
    the smaller one, without looking at its bytes; equal values compare from that position on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads: list[bytes] = [b""] * k
    known = [0] * k
    for r, s in enumerate(streams):
        got = next(s, None)
        if got is None:
            known[r] = -1
        else:
            heads[r] = got[1]

    def beats(r: int, other: int) -> bool:
        """Both share ``known`` bytes with the last winner; sets the loser's value to what it shares with the winner."""
        p = first_difference(a := heads[r], b := heads[other], known[r])
        if p == len(a) or (p < len(b) and a[p] < b[p]):
            known[other] = p
            return True
        known[r] = p
        return False

    losers = [0] * k
    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        winners = []
        for i in range(width):
            a, b = level[2 * i], level[2 * i + 1]
            if known[a] < 0 or (known[b] >= 0 and not beats(a, b)):
                a, b = b, a
            winners.append(a)
            losers[width + i] = b
        level = winners
    w = level[0]
    while known[w] >= 0:
        yield known[w], heads[w], w
        got = next(streams[w], None)
        if got is None:
            known[w] = -1
        else:
            known[w], heads[w] = got
        node = (w + k) >> 1
        h = known[w]
        while node:
            o = losers[node]
            g = known[o]
            if g > h or (g == h and h >= 0 and not beats(w, o)):
                losers[node], w = w, o
            h = known[w]
            node >>= 1


