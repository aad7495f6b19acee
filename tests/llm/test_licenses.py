from __future__ import annotations

import random

from tests.llm import edge
from tidepool.llm.licenses import TEMPLATES, Scanner, Settings, align, anchors, common_subsequence, find_licenses


def test_alignment_is_a_rising_match_no_longer_than_the_longest():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.randrange(10) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(common_subsequence(a, b))
        once = [(i, j) for i, j in anchors(a, b)]
        assert all(a.count(a[i]) == 1 == b.count(b[j]) for i, j in once)


def test_anchors_are_the_longest_rising_series():
    rng = random.Random(2)
    for _ in range(500):
        a, b = rng.sample(range(12), 9), rng.sample(range(12), 9)
        assert len(anchors(a, b)) == len(common_subsequence(a, b))  # all words occur once


def test_templates_are_found_in_prose_with_small_changes():
    scanner = Scanner(TEMPLATES, Settings())
    rng = random.Random(3)
    for name, template in TEMPLATES.items():
        words = template.split()
        changed = list(words)
        for _ in range(len(words) // 12):
            changed[rng.randrange(1, len(words))] = rng.choice(edge.WORDS)
        for w in (words, changed):
            text = f"{edge.prose(1, 300)} {' '.join(w)} {edge.prose(2, 300)}"
            hits = scanner.scan([text.encode()])[0]
            own = [h for h in hits if scanner.names[h[0]] == name]
            assert len(own) == 1 and 300 <= own[0][1] and own[0][2] <= 300 + len(w), name
    assert scanner.scan([edge.prose(9, 5000).encode(), b"", b"license license the the under"]) == [[], [], []]


def test_exact_texts_are_covered_whole_behind_stray_words():
    scanner = Scanner(TEMPLATES, Settings())
    for t, name in enumerate(scanner.names):
        words = TEMPLATES[name].split()
        n = len(scanner.words[t])
        for stray in (words[0], "a", "the", "of", "this"):
            for gap in range(0, n // 2, 1 + n // 12):
                text = f"{edge.prose(3, 30)} {stray} {edge.prose(4, gap)} {TEMPLATES[name]} {edge.prose(5, 30)}"
                own = [h for h in scanner.scan([text.encode()])[0] if h[0] == t]
                assert own == [(t, 31 + gap, 31 + gap + len(words), n)], (name, stray, gap)


def found(text: str) -> dict[str, tuple]:
    scanner = Scanner(TEMPLATES, Settings())
    return {scanner.names[h[0]]: h[1:] for h in scanner.scan([text.encode()])[0]}


def test_hits_of_any_length_without_strays():
    """Words put into a text of a license, in one place or all over, make the hit longer; stray words far from it don't."""
    for name in ("mit", "bsd-2-clause", "apache-2.0"):
        words = TEMPLATES[name].split()
        for many in (60, 300):
            text = f"{edge.prose(7, 40)} {' '.join(words[:30])} {edge.prose(8, many)} {' '.join(words[30:])} {edge.prose(9, 40)}"
            assert found(text)[name] == (40, 40 + len(words) + many, len(words)), (name, many)
        spread = " ".join(f"{w} {x}" for w, x in zip(words, edge.prose(10, len(words)).split()))
        assert found(f"{edge.prose(7, 40)} {spread}")[name][2] == len(words)
        assert found(f"{words[0]} {edge.prose(11, 500)} {TEMPLATES[name]}")[name] == (501, 501 + len(words), len(words))
    assert found("This License is a " + TEMPLATES["cc-by-4.0"])["cc-by-4.0"] == (4, 16, 12)


def test_words_that_tell_licenses_apart():
    assert list(found("Released under the BSD License.")) == ["bsd-notice"] and found("Released under the Tide License.") == {}
    assert found("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == {}
    assert found("This work is licensed under a Creative Commons Attribution 3.0 International License.") == {}
    assert found("This work is licensed under the GNU General Public License, version 2.") == {}


def brute(template: list[int], ids: list[int], telling: set[int], need: int, cost: float) -> int:
    """Most partners of any hit, over all ways to pair rising places: by dynamic programming on (partners, worth) of series that end in a pair."""
    best: dict[tuple[int, int], list[tuple[int, float, frozenset]]] = {}
    most = 0
    for i, w in enumerate(template):
        for j, x in enumerate(ids):
            if w != x:
                continue
            own = [(1, 1.0, frozenset({w} & telling))]
            for (a, b), series in best.items():
                if a < i and b < j:
                    own += [(n + 1, v - cost * max(0, j - b - (i - a)) + 1, t | ({w} & telling)) for n, v, t in series if v - cost * max(0, j - b - (i - a)) > 0]
            own.sort(key=lambda s: (-s[0], -s[1]))
            kept: list = []
            for s in own:
                if not any(k[0] >= s[0] and k[1] >= s[1] and k[2] >= s[2] for k in kept):
                    kept.append(s)
            best[i, j] = kept
            most = max([most, *(n for n, _, t in kept if t >= telling and n >= need)])
    return most


def test_scan_against_all_ways_to_align():
    """A text is found exactly when some alignment holds, and with as many partners but for what patience alignment gives away."""
    rng = random.Random(12)
    scanner = Scanner({"t": "one two three four five six seven eight"}, Settings(), {"t": ("three",)})
    number = {w.decode(): i for w, i in scanner.number.items()}
    agreed = some = 0
    for _ in range(400):
        words = "one two three four five six seven eight".split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(8)] = rng.choice(["tide", "one", "four", "moon"])
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "y", "z", "two", "six"]))
        ids = [number.get(w, 0) for w in words]
        want = brute(scanner.words[0], ids, scanner.telling[0], scanner.need[0], scanner.cost[0])
        got = max((h[3] for h in scanner.scan([" ".join(words).encode()])[0]), default=0)
        assert got <= want
        agreed += got == want
        some += want > 0
    assert some > 60 and agreed >= 390, (some, agreed)


def test_edited_copy_before_an_exact_one_is_kept():
    scanner = Scanner(TEMPLATES, Settings())
    name = "cc-by-sa-4.0"
    words = TEMPLATES[name].split()
    text = f"a {edge.prose(6, 7)} {' '.join(words[:4] + words[5:])} {' '.join(words)}"
    assert [h[1:] for h in scanner.scan([text.encode()])[0] if scanner.names[h[0]] == name] == [(8, 19, 11), (19, 31, 12)]


def test_every_hit_counts():
    scanner = Scanner(TEMPLATES, Settings())
    text = " ".join(f"{edge.prose(i, 20)} Released under the MIT License." for i in range(40))
    assert sum(scanner.names[h[0]] == "mit-notice" for h in scanner.scan([text.encode()])[0]) == 40


def test_edge_rows(spark):
    rows = find_licenses(edge.documents(spark, [*edge.TEXTS, (20, "x Licensed under CC BY-NC 4.0. y")], extra=False)).collect()
    assert {r["doc_id"]: r["license"] for r in rows if r["license"]} == {20: "cc-by-nc-4.0-notice"} and len(rows) == len(edge.TEXTS) + 1
    assert find_licenses(edge.documents(spark)).count() == len(edge.TEXTS) and find_licenses(edge.empty(spark)).count() == 0
