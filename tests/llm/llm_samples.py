"""Made-up prose for the tests of the operators."""

from __future__ import annotations

import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "re") for b in ("n", "s", "t") for c in ("a", "el", "or", "um", "ish")]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (".\n" if draw.random() < 0.05 else "") for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join(f"edit{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split(" "))
