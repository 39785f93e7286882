"""The license scan against an alignment of every template with all that is free in a text."""

import random

import numpy as np
import pytest

from syllabrook.llm import license_scan as ls


def everywhere(text):
    """Every template, from the longest, aligned with every free stretch of words until it holds no more; nothing is compressed."""
    s = ls.Scan(text)
    finds = []
    for t in ls._templates():
        todo = [(0, len(s.start))]
        while todo:
            a, b = todo.pop()
            free = np.flatnonzero(~s.taken[a:b])
            for part in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1) if len(free) else ():
                x, y = a + int(part[0]), a + int(part[-1]) + 1
                if place := ls.confirm(t, s.words(x, y)):
                    d, i, j = place
                    finds.append(ls.Find(t.license, int(s.start[x + i]), int(s.end[x + j - 1]), d))
                    s.taken[x + i : x + j] = True
                    todo += [(x, x + i), (x + j, y)]
    return sorted(finds, key=lambda f: f.start)


def edited(rnd, text, share):
    words = text.split()
    for _ in range(int(len(words) * share)):
        k = rnd.randrange(len(words))
        match rnd.randrange(3):
            case 0:
                words[k] = "changed"
            case 1:
                del words[k]
            case _:
                words.insert(k, "extra")
    return " ".join(words)


def fixture(seed):
    """Plain words with notices that are whole, edited, cut, repeated, nested in others or broken into lines."""
    rnd = random.Random(seed)
    plain = lambda n: " ".join("".join(rnd.choices(["ba", "no", "ti", "re", "sul", "the", "of", "ing"], k=rnd.randint(1, 3))) for _ in range(n))
    out = [plain(rnd.randint(0, 80))]
    for _ in range(rnd.randint(1, 4)):
        _, t = rnd.choice(ls.TEMPLATES)
        match rnd.randrange(6):
            case 0:
                out.append(t.upper())
            case 1:
                out.append(edited(rnd, t, 0.08))
            case 2:
                out.append(" ".join(t.split()[: len(t.split()) // 3]))
            case 3:
                out.append(f"{t}\n{t}")
            case 4:
                out.append(t.replace(" ", "\n"))
            case _:
                out.append(t)
        out.append(plain(rnd.randint(0, 60)))
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(120))
def test_equals_an_alignment_everywhere(seed):
    text = fixture(seed)
    got, want = ls.scan(text)[1], everywhere(text)
    assert [(f.license, f.start, f.end, f.differences) for f in got] == [(f.license, f.start, f.end, f.differences) for f in want]


def test_whole_texts_win_over_their_sentences():
    by_length = sorted(ls.TEMPLATES, key=lambda t: -len(t[1]))
    for name, text in by_length[:12]:
        found = ls.scan(f"Some words before it.\n{text}\nAnd after.")[1]
        assert [f.license for f in found] == [name], name


def test_versions_and_names_tell_licenses_apart():
    gpl2, gpl3 = (next(t for n, t in ls.TEMPLATES if n == name and len(t) > 300) for name in ("GPL-2.0", "GPL-3.0"))
    assert [f.license for f in ls.scan(gpl2)[1]] == ["GPL-2.0"] and [f.license for f in ls.scan(gpl3)[1]] == ["GPL-3.0"]
    assert not any(f.license.startswith("GPL") for f in ls.scan(gpl3.replace("version 3", "version 7"))[1])
    assert ls.scan("Licensed under CC BY-ND 4.0.")[1] == []


def test_compression_decides_what_is_compared(monkeypatch):
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) + " Released under the MIT License."
    seen = []
    monkeypatch.setattr(ls, "confirm", lambda t, b, f=ls.confirm: seen.append(t.license) or f(t, b))
    assert [f.license for f in ls.scan(text)[1]] == ["MIT"] and len(seen) <= 4
    monkeypatch.setattr(ls, "LEAST_SAVED", 10**6)
    assert ls.scan(text) == (0, [])


def test_a_text_of_megabytes_with_one_notice():
    rnd = random.Random(4)
    words = [f"word{rnd.randrange(10**5)}" for _ in range(200_000)]
    words[150_000:150_000] = "Released under the MIT License.".split()
    text = " ".join(words)
    (f,) = ls.scan(text)[1]
    assert text[f.start : f.end] == "Released under the MIT License."


def test_empty_and_blank_texts():
    assert ls.scan(None) == ls.scan("") == ls.scan(" \n\t") == (0, [])
    assert ls.scan("MIT")[1] == []
