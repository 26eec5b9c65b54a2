import re

import pytest

from palisade.llm import licenses


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = ["Released under the MIT License.", "mit-license; Apache  License! apache license", "xcc by cc by é cc BY", "GNU General\nPublic License, version 3", None, "", "commit licensed", "Apachelicense", "MİT license", "a " * 5000 + "CC by"]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert licenses.Scanner().scan((text or "").encode())[:5] == base(text)


def edits(a, b):
    """Fewest edits from ``a`` to any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, d in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def test_fuzzy_equals_brute_force():
    import random

    rng, scanner = random.Random(2), licenses.Scanner()
    for _ in range(400):
        notice = rng.choice(scanner.notices)
        t = list(notice.words)
        for _ in range(rng.randint(0, notice.edits + 2)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice("abcxyz ")], [t[k], rng.choice("abcxyz")]])
        t = " lorem " + "".join(t) + " ipsum "
        found = {s[2] for s in scanner.spans(t)}
        for x in scanner.notices:
            if edits(x.words, t) <= x.edits:
                assert x.label in found, (x, t)
        assert found <= {x.label for x in scanner.notices if edits(x.words, t) <= x.edits}


def test_spans_in_words():
    got = licenses.Scanner().scan(b"one two: released undr the MIT Licence, end")
    assert got[5] == "mit" and got[7][0]["first_word"] == 2 and got[7][0]["last_word"] == 6 and 0.9 < got[6] < 1


def test_scan(docs, empty, clashing, rows):
    got = licenses.scan(docs).collect()
    assert sorted(((r.text, r.n_words, r.n_base) for r in got), key=str) == sorted(((t, *base(t)[:2]) for _, t, *_ in rows), key=str)
    assert licenses.scan(empty).count() == 0 and licenses.scan(clashing).count() == len(rows)


def test_adjacent_notices():
    """Of notices that stand close together each is found, whichever has the edits."""
    whole, edited, gap = "gnu general public license", "gnu generl public license", "gnu general publik license"
    for parts in ([edited, whole], [whole, edited], [edited, whole, gap], [gap, edited, whole, whole, edited]):
        spans = licenses.Scanner().scan(" ".join(parts).encode())[7]
        assert [(s["first_word"], s["last_word"]) for s in spans if s["label"] == "gpl"] == [(4 * i, 4 * i + 3) for i in range(len(parts))]
        assert [round(s["similarity"] * 26) for s in spans if s["label"] == "gpl"] == [26 if p == whole else 25 for p in parts]
