"""One pass over people sorted by stratum and falling time: risk-set sums, event days, derivatives of a Cox model.

A task keeps the sums of its stratum and the last, unfinished day; what an earlier task leaves open is handed on as
a ``Carry``.  Blocks of rows are worked on as arrays; nothing grows with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from wardline.functions.tiesums import efron

EVENT_SUMS = ("dn", "d0", "dw", "deta")
DAY = ("S0", "S1", "dn", "d0", "dw", "deta", "d1", "dx", "g")


@dataclass
class Carry:
    """Sums of a stratum so far (``S0``, ``S1``, ``S2``) and of the events of its last day; ``d2`` is their p x p sum."""

    p: int
    s: str | None = None
    t: float | None = None
    S0: float = 0.0
    S1: np.ndarray = field(default=None)
    S2: np.ndarray = field(default=None)
    day: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.S1 is None:
            self.S1, self.S2 = np.zeros(self.p), np.zeros((self.p, self.p))
        if not self.day:
            self.clear_day()

    def clear_day(self) -> None:
        self.day = dict.fromkeys(EVENT_SUMS, 0.0) | {
            "d1": np.zeros(self.p), "dx": np.zeros(self.p), "d2": np.zeros((self.p, self.p)), "g": 0.0}


def hand_on(parts: list[dict]) -> tuple[dict[int, Carry], set[int]]:
    """For each part, in order: what it starts with; and the parts whose last day goes on in the next one."""
    starts, open_ended = {}, set()
    before: Carry | None = None
    number = None
    for part in parts:
        mine: Carry = part["carry"]
        start = Carry(mine.p)
        if before is not None and before.s == part["first_s"]:
            start = Carry(mine.p, before.s, before.t, before.S0, before.S1, before.S2, dict(before.day))
            if before.t == part["first_t"]:
                open_ended.add(number)
            else:  # the part before has finished its last day
                start.t = None
                start.clear_day()
        starts[part["part"]] = start
        end = Carry(mine.p, mine.s, mine.t, mine.S0, mine.S1, mine.S2, dict(mine.day))
        if part["one_stratum"] and start.s == mine.s:
            end.S0, end.S1, end.S2 = mine.S0 + start.S0, mine.S1 + start.S1, mine.S2 + start.S2
            if part["one_day"] and start.t == mine.t:
                end.day = {k: v + start.day[k] if k != "g" else v for k, v in mine.day.items()}
        before, number = end, part["part"]
    return starts, open_ended


class Scan:
    """Takes blocks in order; adds up log-likelihood, scores and information for powers of g, or only the sums."""

    def __init__(self, p: int, beta: np.ndarray, start: Carry | None = None, powers=(0,), evaluate: bool = True, emit=None):
        self.p, self.beta, self.powers, self.evaluate, self.emit = p, beta, powers, evaluate, emit
        self.now = start or Carry(p)
        self.like, self.score, self.info = 0.0, np.zeros((3, p)), np.zeros((3, p, p))
        self.first = self.seen = None
        self.strata = self.days = 0  # begun here

    def take(self, s: list, t: np.ndarray, d: np.ndarray, w: np.ndarray, n: np.ndarray, x: np.ndarray, g: np.ndarray) -> None:
        if not len(t):
            return
        eta = x @ self.beta
        cuts = [0, *[i for i in range(1, len(s)) if s[i] != s[i - 1]], len(s)]
        if self.first is None:
            self.first = (s[0], float(t[0]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            self._stratum(s[a], t[a:b], d[a:b] == 1, w[a:b], n[a:b], x[a:b], g[a:b], eta[a:b])

    def _stratum(self, s, t, ev, w, n, x, g, eta) -> None:
        now = self.now
        if now.s != s:
            self.finish_day()
            self.now = now = Carry(self.p, s)
        starts = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
        same = now.t == t[0]
        if now.t is not None and not same:
            self.finish_day()
            now.clear_day()
        self.strata += self.seen is None or self.seen[0] != s
        self.days += len(starts) - (self.seen == (s, float(t[0])))
        self.seen = (s, float(t[-1]))
        r = w * np.exp(eta)
        re, we = np.where(ev, r, 0.0), np.where(ev, w, 0.0)
        add = lambda v: np.add.reduceat(v, starts, axis=0)
        table = {"S0": now.S0 + np.cumsum(add(r)), "S1": now.S1 + np.cumsum(add(r[:, None] * x), axis=0),
                 "dn": add(np.where(ev, n, 0.0)), "d0": add(re), "dw": add(we), "deta": add(we * eta),
                 "d1": add(re[:, None] * x), "dx": add(we[:, None] * x), "g": g[starts]}
        if same:
            for k in (*EVENT_SUMS, "d1", "dx"):
                table[k][0] = table[k][0] + now.day[k]
        groups = len(starts)
        if self.evaluate and groups > 1:
            whole = {k: v[:-1] for k, v in table.items()}
            hazard, own = self._evaluate(s, t[starts[:-1]], whole)
            which = np.repeat(np.arange(groups), np.diff([*starts, len(t)]))
            for i, k in enumerate(self.powers):
                later = np.append(np.cumsum(hazard[i][::-1])[::-1], 0.0)
                h = later[which] - np.where(ev, np.append(own[i], 0.0)[which], 0.0)
                self.info[k] += (x * (r * h)[:, None]).T @ x + hazard[i].sum() * now.S2
                if same:
                    self.info[k] -= own[i][0] * now.day["d2"]
        last = slice(starts[-1], None)
        d2 = (x[last] * re[last, None]).T @ x[last]
        if same and groups == 1:
            d2 = d2 + now.day["d2"]
        now.S2 = now.S2 + (x * r[:, None]).T @ x
        now.S0, now.S1, now.t = float(table["S0"][-1]), table["S1"][-1], float(t[-1])
        now.day = {k: table[k][-1] for k in (*EVENT_SUMS, "d1", "dx", "g")} | {"d2": d2}

    def finish_day(self) -> None:
        """The day held open is complete."""
        now = self.now
        if now.t is None or not self.evaluate:
            return
        table = {"S0": np.array([now.S0]), "S1": now.S1[None, :]}
        table |= {k: np.array([now.day[k]]) for k in (*EVENT_SUMS, "d1", "dx", "g")}
        hazard, own = self._evaluate(now.s, np.array([now.t]), table)
        for i, k in enumerate(self.powers):
            self.info[k] += hazard[i][0] * now.S2 - own[i][0] * now.day["d2"]

    def _evaluate(self, s, t, table: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Adds what days contribute on their own; their hazard and what their tied events leave out of it."""
        a0, a1, c0, c1, c2, ll = sums = efron(table["dn"], table["S0"], table["d0"])
        wbar = table["dw"] / np.maximum(table["dn"], 1)
        if self.emit:
            self.emit(s, t, table, wbar, sums)
            return [np.zeros(len(t))], [np.zeros(len(t))]
        s1, d1, g = table["S1"], table["d1"], table["g"]
        self.like += float(np.sum(table["deta"] - wbar * ll))
        u = table["dx"] - wbar[:, None] * (a0[:, None] * s1 - a1[:, None] * d1)
        hazard, own = [], []
        for k in self.powers:
            f = wbar * g ** k
            self.score[k] += (u * (g ** k)[:, None]).sum(0)
            cross = (s1 * (f * c1)[:, None]).T @ d1
            self.info[k] -= (s1 * (f * c0)[:, None]).T @ s1 - cross - cross.T + (d1 * (f * c2)[:, None]).T @ d1
            hazard.append(f * a0)
            own.append(f * a1)
        return hazard, own

    def summary(self, part: int) -> dict | None:
        if self.first is None:
            return None
        return {"part": part, "first_s": self.first[0], "first_t": self.first[1], "one_stratum": self.strata == 1,
                "one_day": self.days == 1, "carry": self.now}
