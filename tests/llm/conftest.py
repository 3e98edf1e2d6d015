import itertools
import random

import pytest

WORDS = [a + b for a in "ka lo mi tu ne ra so vi".split() for b in "da fe gi ho ju pe ru za".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))


def edited(text, every, seed):
    r = random.Random(seed)
    words = text.split()
    for k in range(r.randrange(every), len(words), every):
        words[k] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def components(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def shingles(text, n=5, words=None):
    w = (text or "").encode().lower().split() if words is None else words
    if not w:
        return set()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def links_of(sets, percent):
    return [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) rows with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, "z") for i, t in rows], "doc_id long, text string, lang string, key string, n int, a int, b int, ranges string")

    return make
