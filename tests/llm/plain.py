"""Plain, slow versions of what the operators compute, to hold them against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fingerprint(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, linked) -> list[int]:
    """The smallest number each of n things is connected with."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if i != j and label[j] < label[i] and linked(i, j):
                    label[i], changed = label[j], True
    return label


def rule_measures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    base_failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked), base_failed


SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def secrets(text: str | None) -> tuple:
    spans, counts = [], []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        hits = [m for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(hits))
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in hits]
    return (*counts, sha(",".join(s[2] for s in sorted(spans))))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(m) -> str:
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(_digits(m)) <= 15),
]


def personal(text: str | None) -> tuple:
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in p.finditer(text or "") if ok(m)] for k, p, ok in PERSONAL]
    return (*map(len, spans), sha(",".join(s for kind in spans for s in kind)))


def unit(rows) -> np.ndarray:
    x = np.array(rows, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
