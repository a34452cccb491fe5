"""Merging front-coded sorted runs with a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator


def front_code(items: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted byte strings as (length shared with the one before, the rest)."""
    shared, tails, before = [], [], b""
    for item in items:
        at = common_prefix(before, item, 0)
        shared.append(at)
        tails.append(item[at:])
        before = item
    return shared, tails


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are
    known to agree and are not looked at again."""
    end = min(len(a), len(b))
    at, step = known, 16
    while at < end:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + (n if not differ else n - 1 - (differ.bit_length() - 1) // 8)
        at += step
        step *= 4
    return end


class _Run:
    __slots__ = ("lengths", "next", "rest", "size", "source", "tails")

    def __init__(self, source: int, shared: list[int], tails: list[bytes]):
        self.source, self.lengths, self.tails, self.size, self.next = source, shared, tails, len(shared), 0


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, index in it, prefix shared with the item before, item), in order.

    A leaf's ``lcp`` is the prefix its head shares with the last item put out.
    Of two heads the one with the longer such prefix is the smaller; only when
    the two are equal are bytes compared, and then from that prefix on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    lcps = [0] * k
    at = [0] * k
    for r, (_, tails) in enumerate(runs):
        heads[r] = tails[0] if tails else None

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes that with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        x, y = lcps[a], lcps[b]
        if x > y:
            return a, b
        if x < y:
            return b, a
        p, q = heads[a], heads[b]
        h = common_prefix(p, q, x)
        if h == len(p) or (h < len(q) and p[h] < q[h]):
            lcps[b] = h
            return a, b
        lcps[a] = h
        return b, a

    loser = [-1] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        following = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            loser[node + i // 2] = lose
            following.append(win)
        level = following
    win = level[0]
    while heads[win] is not None:
        item = heads[win]
        yield win, at[win], lcps[win], item
        shared, tails = runs[win]
        at[win] += 1
        if at[win] < len(tails):
            lcp = shared[at[win]]
            lcps[win] = lcp
            heads[win] = item[:lcp] + tails[at[win]]
        else:
            heads[win] = None
        pos = (win + k) // 2
        while pos:
            win, loser[pos] = play(win, loser[pos])
            pos //= 2
