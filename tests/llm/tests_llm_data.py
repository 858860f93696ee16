"""Texts for the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "the of and river stone light over under green house window paper moves quickly some many people walk along road".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" if i % 3 else rng.choice(WORDS) for i in range(n))
