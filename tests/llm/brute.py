"""Plain single-process versions that the tests compare with."""

import re

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normalised(text):
    return BLANK.sub(" ", text or "")


def n_words(text):
    return len(WORD.findall(text or ""))


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, radius=2):
    """Smallest index reachable for each of ``prints``."""
    low = list(range(len(prints)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def targets(sizes, weights, most=3):
    """Caps and reshares by weight until none is above."""
    total, fixed, free = sum(sizes), {}, set(range(len(sizes)))
    while free:
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            return [fixed[i] if i in fixed else left * weights[i] / weight for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}
        free -= over
    return [fixed[i] for i in range(len(sizes))]
