import random

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Copies, near copies, shared passages, periodic, empty, null and long texts of a few words."""
    chance = random.Random(11)
    vocabulary = ["".join(chance.choice("abcdeé") for _ in range(chance.randint(1, 7))) for _ in range(300)]

    def words(n):
        return [chance.choice(vocabulary) for _ in range(n)]

    passage = words(90)
    texts = [" ".join(words(chance.randint(1, 200))) for _ in range(40)]
    texts += [" ".join(words(20) + passage + words(30)) for _ in range(12)]
    texts += [" ".join(words(5) + passage[:60]), " ".join(passage[30:] + words(5)), "\n".join(passage)]
    for k in range(10):
        near = texts[5].split() + passage
        near[chance.randrange(len(near))] = f"x{k}"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], texts[7], "a" * 900, "ab" * 300, "ba " * 300, " ".join(["same"] * 130), "", None, None, "\n\t ", "short", "Short", "é" * 250]
    texts.append(" ".join(words(40_000) + passage))
    texts.append("tail " * 3 + " ".join(words(60)) + "\x00\x0b\x0c\x1c\x85  ")
    return texts
