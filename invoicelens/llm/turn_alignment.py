"""Alignment of a run of turns with the alternating grammar ``(s?(ua)+)?``, by least cost of edits.

Each feasible length of the grammar's string is a target of its own: Wagner-Fischer fills the costs from the ends, inside the
Ukkonen band that the best cost so far leaves, and the edits are traced back. Of the cheapest scripts of all lengths the
ASCII-least is taken.

A turn is one letter: ``s``, ``u``, ``a`` by its role's initial or ``x`` for any other, the same in upper case for a truncated
turn, ``D`` for one that has to be deleted. Edits: ``K`` keeps a turn (0), ``R`` gives it the role user or assistant (1), ``D``
deletes it (2), ``I`` adds an empty user or assistant turn (5). A truncated turn that stays costs 5 more.
"""

from __future__ import annotations

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What the string written so far ends in: nothing, s, u or a.
STATES = ("", "s", "u", "a")
ACCEPTED = ("", "a")
_NEVER = 1 << 60


def shift_cost(diagonal: int) -> int:
    """The least cost of getting ``diagonal`` places ahead of the turns (or behind, if negative)."""
    return INSERT * diagonal if diagonal > 0 else -DELETE * diagonal


def target(start: str, end: str, length: int) -> str | None:
    """The string of ``length`` that leads from state ``start`` to state ``end``, if there is one."""
    if length == 0:
        return "" if start == end else None
    first = "s" if start == "" and (end == "s" or (length % 2 == 1) == (end == "a")) else "a" if start == "u" else "u"
    rest = "ua" if first in "sa" else "au"
    made = (first + rest * length)[:length]
    return made if made[-1] == end else None


def align(turns: str, goal: str, limit: int = _NEVER) -> tuple[int, str] | None:
    """The cheapest edits that turn ``turns`` into ``goal``, the ASCII-least of them; None if they cost more than ``limit``."""
    n, m = len(turns), len(goal)
    apart = m - n
    if shift_cost(apart) > limit:
        return None
    low, high = min(0, apart), max(0, apart)
    while low > -n and shift_cost(low - 1) + shift_cost(apart - low + 1) <= limit:
        low -= 1
    while high < m and shift_cost(high + 1) + shift_cost(apart - high - 1) <= limit:
        high += 1
    cost = [[_NEVER] * (m + 1) for _ in range(n + 1)]

    def steps(i: int, j: int) -> list[tuple[str, int, int, int]]:
        """The edits at turn ``i`` and place ``j`` in ASCII order, with the total each leads to."""
        out = []
        stays = i < n and turns[i] != "D"
        extra = TRUNCATED if stays and turns[i].isupper() else 0
        if i < n:
            out.append(("D", cost[i + 1][j] + DELETE, i + 1, j))
        if j < m and goal[j] != "s":
            out.append(("I", cost[i][j + 1] + INSERT, i, j + 1))
        if j < m and stays and turns[i].lower() == goal[j]:
            out.append(("K", cost[i + 1][j + 1] + extra, i + 1, j + 1))
        if j < m and stays and goal[j] != "s":
            out.append(("R", cost[i + 1][j + 1] + RENAME + extra, i + 1, j + 1))
        return out

    for i in range(n, -1, -1):
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            cost[i][j] = 0 if (i, j) == (n, m) else min((s[1] for s in steps(i, j)), default=_NEVER)
    if cost[0][0] > limit or cost[0][0] >= _NEVER:
        return None
    i = j = 0
    script = []
    while (i, j) != (n, m):
        edit, _, i, j = next(s for s in steps(i, j) if s[1] == cost[i][j])
        script.append(edit)
    return cost[0][0], "".join(script)


def best_script(turns: str, start: str, end: str) -> tuple[int, str] | None:
    """The cheapest script from state ``start`` to state ``end`` over all feasible lengths, the ASCII-least of them."""
    forced = turns.count("D")
    free = len(turns) - forced
    best: tuple[int, str] | None = None
    # Lengths by distance from the number of turns that may stay; two more than any bound allows close the search.
    for away in range(0, 2 * len(turns) + 8):
        least = DELETE * forced + min(shift_cost(away), shift_cost(-away))
        if best is not None and least > best[0]:
            break
        for length in {free - away, free + away}:
            if length < 0 or (best is not None and DELETE * forced + shift_cost(length - free) > best[0]):
                continue
            goal = target(start, end, length)
            if goal is None:
                continue
            found = align(turns, goal, best[0] if best is not None else _NEVER)
            if found is not None and (best is None or found < best):
                best = found
    return best


def script_table(turns: str, starts: tuple[str, ...] = STATES) -> list[tuple[int, str] | None]:
    """``best_script`` for each pair of states, row by row; rows of states that are not in ``starts`` are empty."""
    return [best_script(turns, start, end) if start in starts else None for start in STATES for end in STATES]


def apply_script(script: str, start: str, turns: list[tuple[str, str]]) -> tuple[list[tuple[str, str, str]], str]:
    """The turns (edit, role, text) that ``script`` leaves of ``turns`` (role, text), and the state they end in."""
    out, state, at = [], start, 0
    for edit in script:
        role, text = turns[at] if edit in "KR" else ("", "")
        if edit != "K":
            role = "assistant" if state == "u" else "user"
        at += edit != "I"
        if edit != "D":
            out.append((edit, role, text))
            state = role[:1]
    return out, state
