import random

SYLLABLES = "ka lo mi ne tu ra so vi pe du ga ho".split()


def prose(rng: random.Random, words: int) -> str:
    """Words of one to four syllables."""
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))
