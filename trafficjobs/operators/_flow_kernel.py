"""Where the flows of ordered packets end, for the batch and the streaming job alike.

All that can end a flow is a position among its connection's packets: the packet that fills it, the next closing one, the one
after the next silence, the first at the active deadline. The cut goes from flow to flow by these positions, and arrays over
all packets give the flows' columns.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

# TCP flag bits.
SYN, ACK, CLOSING = 0x02, 0x10, 0x05


@dataclass
class Rest:
    """What a connection leaves behind: an open flow from the position first on, or the tail of a full flow that began at since."""

    first: int | None = None
    since: int | None = None


class Packets:
    """Packets ordered by connection and time. lo tells whether the lower endpoint sent them, own whether both endpoints are one."""

    def __init__(self, ts: np.ndarray, lo: np.ndarray, length: np.ndarray, flags: np.ndarray, own: np.ndarray, limits):
        self.ts, self.lo, self.length, self.flags, self.own, self.limits = ts, lo, length, flags, own, limits
        self.times = ts.tolist()
        self.closing = np.flatnonzero(flags & CLOSING).tolist()
        self.begin = np.flatnonzero((flags & (SYN | ACK)) == SYN).tolist()
        self.silence = (np.flatnonzero(np.diff(ts) >= limits.idle_us) + 1).tolist()

    @staticmethod
    def _next(positions: list[int], at: int, end: int) -> int:
        """The first of the positions from at on, or end."""
        k = bisect_left(positions, at)
        return min(positions[k], end) if k < len(positions) else end

    def due(self, start: int, last: int) -> tuple[int, str]:
        """When what began and was last heard of then ends, and why; silence goes before age."""
        return min((last + self.limits.idle_us, "idle_timeout"), (start + self.limits.active_us, "active_timeout"), key=lambda x: x[0])

    def cut(self, at: int, end: int, rest: Rest) -> tuple[list[tuple[int, int, str]], Rest]:
        """The flows (first, behind, reason) of one connection's packets in at to end, and what is left of them. rest is what stood before."""
        found, since = [], rest.since
        while at < end:
            start = self.times[at] if since is None else since
            aged = max(bisect_left(self.times, start + self.limits.active_us, at, end), at + (since is None))
            timed = min(aged, self._next(self.silence, at + (since is None), end))
            closed = self._next(self.closing, at, end)
            if since is not None:  # nothing of a full flow's tail counts until it closes, falls silent, ages or begins anew
                anew = min(timed, self._next(self.begin, at, end))
                at, since = (closed + 1, None) if closed < anew else (anew, None if anew < end else since)
                continue
            full = at + self.limits.max_packets - 1
            last = min(full, closed)
            if last < timed:
                found.append((at, last + 1, "max_packets" if last == full else "tcp_close"))
                since = start if last == full and closed != full else None
                at = last + 1
            elif timed < end:
                found.append((at, timed, self.due(start, self.times[timed - 1])[1]))
                at = timed
            else:
                return found, Rest(first=at)
        return found, Rest(since=since)

    def columns(self, flows: list[tuple[int, int, str]]) -> dict[str, np.ndarray]:
        """Of flows that are long enough: first, begun_by_lo, started_us, ended_us, close_reason; sizes and offsets_us one flow after the other, and their ends."""
        flows = [f for f in flows if f[1] - f[0] >= self.limits.min_packets]
        first, behind = (np.array([f[k] for f in flows], dtype=np.int64) for k in (0, 1))
        counts = behind - first
        ends = np.concatenate(([0], np.cumsum(counts)))
        of = np.repeat(np.arange(len(flows)), counts)
        at = np.arange(len(of)) - ends[of] + first[of]
        # the sender of the first packet began, or its receiver if it is an answer; without either flag the first SYN tells
        teller = np.array([a if self.flags[a] & SYN else self._next(self.begin, a, b) for a, b, _ in flows], dtype=np.int64)
        teller = np.where(teller < behind, teller, first)
        answer = ((self.flags[first] & (SYN | ACK)) == SYN | ACK) & ~self.own[first]
        lo = self.lo[teller] ^ answer
        return {
            "first": first, "begun_by_lo": lo, "started_us": self.ts[first], "ended_us": self.ts[behind - 1] if len(flows) else first,
            "close_reason": [f[2] for f in flows], "sizes": np.where(self.lo[at] == lo[of], self.length[at], -self.length[at]), "offsets_us": self.ts[at] - self.ts[first][of], "ends": ends,
        }
