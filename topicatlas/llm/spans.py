"""Spans of fixed kinds in whole texts, and the text form they are compared in."""

import hashlib

Span = tuple[int, int, str]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apart(found: list[tuple[int, int]], taken: list[Span]) -> list[tuple[int, int]]:
    """The spans of ``found`` that overlap none of ``taken`` and no earlier one of their own."""
    kept, busy = [], sorted((a, b) for a, b, _ in taken)
    last, i = 0, 0
    for a, b in sorted(found):
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if a >= last and not any(x < b and y > a for x, y in busy[i : i + 4] + busy[max(0, i - 4) : i]):
            kept.append((a, b))
            last = b
    return kept
