"""Plain single-machine versions of the operators, for small tables."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Columns a table may have besides its own, named like the operators' inner ones.
CLASHING = "row id key bucket phase ids keys token node nid grp n size score hash route tokens text_2".split()


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").encode().lower().decode()


def sentence(rng, count):
    return " ".join(rng.choice(("ka", "lo", "mi", "re", "su")) + str(rng.randrange(400)) for _ in range(count))


def corpus(seed=3, count=60):
    """(doc_id, text, lang, source, n_chars) with every awkward case in it."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 40), sentence(rng, 14)
    rows = []
    for k in range(count):
        text = sentence(rng, rng.randint(1, 90))
        if k % 4 == 0:
            text = f"{text}\n{passage}\t {sentence(rng, 5)}"
        if k % 3 == 0:
            text += "\n" + line
        rows.append([10 + 3 * k, text])
    base = sentence(rng, 80).split()
    for k in range(12):  # near copies, some close and some not
        copy = list(base)
        for _ in range(k // 2):
            copy[rng.randrange(80)] = f"edit{rng.randrange(999)}"
        rows.append([500 + k, " ".join(copy)])
    rows += [[700 + k, rows[4][1]] for k in range(5)]  # copies
    rows += [[2, None], [3, ""], [4, " \n\t "], [5, "one"], [6, "One"], [7, "a b"], [8, "a b c"]]
    rows += [[9, "x " * 60], [800, "x " * 40], [801, "x " * 13 + "y"]]
    rows += [[900, sentence(rng, 6000)]]
    rows += [list(rows[1]), list(rows[1])]  # repeated rows
    rows += [[None, rows[0][1]], [None, sentence(rng, 30)]]
    sources = ["s1", "s1", "s1", "s2", None, "Ä", "s10"]
    return [
        (i, t, "en", sources[k % len(sources)], len(t or "")) for k, (i, t) in enumerate(rows)
    ]


def components(rows, width=3, percent=90):
    """(doc_id, set size, component) per row, by comparing all pairs of distinct sets."""
    sets = []
    for doc_id, text, *_ in rows:
        w = words(lower(text))
        few = {tuple(w)} if w else set()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset(few))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for k, (doc_id, *_) in enumerate(rows):
        members = [r[0] for j, r in enumerate(rows) if root(j) == root(k) and r[0] is not None]
        least = min(members) if members and sets[k] else doc_id
        out.append((doc_id, len(sets[k]), least))
    return out


def without_repeats(rows, width=13):
    """(doc_id, words, removed, kept text) per row."""
    last = float("inf")
    least = {}
    for doc_id, text, *_ in rows:
        w, key = words(text), last if doc_id is None else doc_id
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            least[window] = min(key, least.get(window, last))
    out = []
    for doc_id, text, *_ in rows:
        w, key = words(text), last if doc_id is None else doc_id
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < key:
                gone[k : k + width] = [True] * width
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """Target per source, by capping and resharing until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        shared = sum(weight[s] for s in names if s not in full)
        over = {
            s for s in names if s not in full and rest * weight[s] > most * sizes[s] * shared
        }
        if not over:
            break
        full |= over
    return {s: most * sizes[s] if s in full else rest * weight[s] / shared for s in names}


def by_id(rows):
    return sorted(rows, key=repr)
