"""Small documents with every awkward case, and plain versions of what the operators compute."""

import random

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=7, n=60):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(20, 120))) for _ in range(n)]
    passage = " ".join(f"shared{i}" for i in range(40))
    out = list(base)
    out += [base[0]] * 5 + [base[1] + " tail", "head " + base[1]]
    out += [f"{b} {passage} end{i}" for i, b in enumerate(base[2:8])]
    for i in range(8):
        w = base[9].split()
        w[rnd.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    return [*out, None, "", " \t\n", "x", "One two", "one TWO", "aaaa" * 300, "é ü 漢字 " * 20, "a" * 60]


def rows(seed=7):
    langs, sources = ["en", "de", None], ["b", "a", None, "a"]
    out = [(i, t, langs[i % 3], sources[i % 4], len(t or "")) for i, t in enumerate(texts(seed))]
    return [*out, out[3], (None, "no id here", "en", None, 10), (None, None, None, None, None)]


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(sets, percent):
    """The index of the first set that each is linked to by a path."""
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]
