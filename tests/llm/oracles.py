"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import collections
import math
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


def repeat_share(text: str | None, n: int = 8) -> float:
    w, seen, covered = words(text), set(), set()
    for i in range(len(w) - n + 1):
        run = tuple(w[i : i + n])
        if run in seen:
            covered.update(range(i, i + n))
        seen.add(run)
    return len(covered) / len(w) if w else 0.0


def leaks(docs: dict, items: dict, n: int = 12) -> dict[tuple, int]:
    """Longest common run of words of each (document, item) that share at least ``n``."""
    out = {}
    for d, text in docs.items():
        a = words(text)
        for i, item in items.items():
            b, best = words(item), 0
            row = [0] * (len(b) + 1)
            for x in a:
                new = [0] * (len(b) + 1)
                for j, y in enumerate(b):
                    if x == y:
                        new[j + 1] = row[j] + 1
                        best = max(best, new[j + 1])
                row = new
            if best >= n:
                out[d, i] = best
    return out


def z_scores(counts: dict[object, dict[str, float]], prior: float) -> dict[tuple, float]:
    total = collections.Counter()
    for c in counts.values():
        total.update(c)
    n_all = sum(total.values())
    out = {}
    for r, c in counts.items():
        n = sum(c.values())
        for term, y in c.items():
            a, a0, rest = prior * total[term], prior * n_all, total[term] - y
            delta = math.log((y + a) / (n + a0 - y - a)) - math.log((rest + a) / (n_all - n + a0 - rest - a))
            out[r, term] = delta / math.sqrt(1 / (y + a) + 1 / (rest + a))
    return out


def paragraph_starts(text: str) -> list[int]:
    at, blank, out = 0, True, []
    for line in text.split("\n"):
        if line.strip():
            if blank:
                out.append(at + len(line) - len(line.lstrip()))
            blank = False
        else:
            blank = True
        at += len(line) + 1
    return out


def greedy_cuts(offsets: list[int], kinds: list[int], limit: int, overlap: int) -> list[int]:
    """One text's cuts, one after the other: the farthest boundary of the best kind in reach."""
    at, out = 0, [0]
    while at != offsets[-1]:
        reach = at + (limit if at == 0 else limit - overlap)
        can = [(6 if k == 6 else -k, p) for p, k in zip(offsets, kinds) if at < p <= reach]
        at = max(can)[1]
        out.append(at)
    return out


def place(values: np.ndarray, p: float) -> float:
    s = np.sort(values)
    return float(s[int(math.floor(p * (len(s) - 1) + 0.5))])


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]
