"""Small per-key state machines shared by the batch and the streaming forms."""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections import deque

from ..functions import fixed

SECOND = 1_000_000


class RateWindow:
    """Sliding window over accepted hits; rejected hits do not count. Times are microseconds."""

    def __init__(self, hits=(), limit: int = fixed.RATE_MAX_HITS, window: int = fixed.RATE_WINDOW_SECONDS):
        self.hits, self.limit, self.window = deque(hits), limit, window * SECOND

    def step(self, row) -> tuple:
        while self.hits and self.hits[0] < row.t - self.window:
            self.hits.popleft()
        accepted = len(self.hits) < self.limit
        if accepted:
            self.hits.append(row.t)
        return (accepted,)


class LoginGuard:
    """Failure counter with a timed lock. ``until`` is microseconds or None."""

    def __init__(self, fails: int = 0, until: int | None = None, attempts: int = fixed.MAX_LOGIN_ATTEMPTS,
                 minutes: int = fixed.LOGIN_LOCK_MINUTES):
        self.fails, self.until, self.attempts, self.lock = fails, until, attempts, minutes * 60 * SECOND

    def step(self, row) -> tuple:
        return (self.action(row.t, bool(row.success)),)

    def action(self, t: int, success: bool) -> str:
        if self.until is not None and self.until > t:
            return "LOGIN_BLOCKED"
        if success:
            self.fails, self.until = 0, None
            return "LOGIN"
        self.fails += 1
        if self.fails < self.attempts:
            return "LOGIN_FAIL"
        self.fails, self.until = 0, t + self.lock
        return "LOGIN_LOCKOUT"


class SeededGuard(LoginGuard):
    """A guard whose first row only brought its state."""

    def step(self, row) -> tuple:
        return (None,) if row.t is None else super().step(row)


class LoginSpan:
    """What a stretch of attempts does to any state of a login guard, without the stretch.

    A guard begins with some failures, or with a lock. ``open[f]`` is the state after the stretch for f failures and no lock. A
    lock matters only by the first attempt it does not block: ``at`` holds times in order and ``after`` the state left by a lock that ends
    at that time or earlier, but after the time before. Runs of equal states are one entry; a lock beyond them all just goes on.
    """

    PIECE = 4096

    def __init__(self, first: int | None, open_states: list, at: list[int], after: list):
        self.first, self.open, self.at, self.after = first, open_states, at, after

    @classmethod
    def nothing(cls, attempts: int = fixed.MAX_LOGIN_ATTEMPTS) -> LoginSpan:
        return cls(None, [(f, None) for f in range(max(1, attempts))], [], [])

    @classmethod
    def of(cls, rows, attempts: int = fixed.MAX_LOGIN_ATTEMPTS, minutes: int = fixed.LOGIN_LOCK_MINUTES) -> LoginSpan:
        """One walk from the last attempt to the first: from any attempt on, the state for each number of failures before it."""
        if not rows:
            return cls.nothing(attempts)
        lock, times = minutes * 60 * SECOND, [r.t for r in rows]
        fresh: list = [None] * len(rows)  # after beginning at this attempt with no failures
        states = [(f, None) for f in range(max(1, attempts))]
        for i in range(len(rows) - 1, -1, -1):
            if rows[i].success:
                states = [states[0]] * len(states)
            else:
                until = times[i] + lock
                j = max(bisect_left(times, until, i + 1), i + 1)
                locked = (0, until) if j == len(rows) else fresh[j]
                states = [*states[1:], locked]
            fresh[i] = states[0]
        ends = [i for i in range(len(rows)) if i + 1 == len(rows) or fresh[i] != fresh[i + 1]]
        return cls(times[0], states, [times[i] for i in ends], [fresh[i] for i in ends])

    def __call__(self, state: tuple[int, int | None]) -> tuple[int, int | None]:
        fails, until = state
        if self.first is None:
            return state
        if until is None or until <= self.first:
            return self.open[fails if until is None else 0]
        i = bisect_left(self.at, until)
        return self.after[i] if i < len(self.at) else state

    def then(self, later: LoginSpan) -> LoginSpan:
        if self.first is None or later.first is None:
            return later if self.first is None else self
        open_states = [later(s) for s in self.open]
        at, after = [], []
        for t, state in [*zip(self.at, map(later, self.after), strict=True), *zip(later.at, later.after, strict=True)]:
            if after and after[-1] == state:
                at[-1] = t
            else:
                at.append(t)
                after.append(state)
        return LoginSpan(self.first, open_states, at, after)

    def dump(self) -> bytes:
        return pickle.dumps((self.first, self.open, self.at, self.after))

    class Walk:
        """Through a user's spans in order: the state at the start of each."""

        def __init__(self):
            self.state = (0, None)

        def step(self, row) -> tuple:
            before = self.state
            self.state = LoginSpan(*pickle.loads(row.span))(before)
            return before


class ChainLink:
    """Running hash of one chain; a row's ``head`` is its record text up to the previous hash."""

    def __init__(self, last_hash: str | None = None):
        self.last_hash = last_hash

    def step(self, row) -> tuple:
        before = self.last_hash
        self.last_hash = hashlib.sha256((row.head + (before or "")).encode("utf-8")).hexdigest()
        return before, self.last_hash
