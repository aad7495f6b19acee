from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa

from tests.llm import edge
from tidepool.llm.repetition import Rules, measure, quality


def brute(text: str | None, rules: Rules = Rules()) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def covered(size: int) -> int:
        seen = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return len({j for i in range(n - size + 1) if seen[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})

    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    longest = 0
    while longest < n and any(c > 1 for c in Counter(tuple(words[i : i + longest + 1]) for i in range(n - longest)).values()):
        longest += 1
    out = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": covered(3), "covered_words": covered(rules.span_words), "longest_repeat": longest}
    out["base_failed"] = n < 50 or 100 * out["n_repeat_words"] > 50 * n
    out["kept"] = not out["base_failed"] and out["covered_words"] <= rules.max_covered * n and longest <= rules.max_longest
    return out


def check(texts: list[str | None], found: dict) -> None:
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: found[k][i] for k in want} == want, t


def test_against_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a a a a", "x\x1cy x\x1cy"] + ["".join(rng.choices(["a ", "b ", "c\n", "é\t", "\x0b#", "d< x ", " ", "long-word "], k=rng.randrange(90))) for _ in range(400)]
    check(texts, measure(pa.array(texts, pa.string()), Rules()))


def test_rules_see_what_the_base_does_not():
    passage = edge.prose(7, 120)
    texts = [edge.prose(8, 200) + " " + passage + " " + edge.prose(9, 200) + " " + passage, edge.prose(10, 200)]
    found = measure(pa.array(texts), Rules())
    assert found["longest_repeat"].tolist()[0] >= 120 and not found["base_failed"].any()
    assert found["kept"].tolist() == [False, True] and found["n_intervals"].tolist() == [1, 0]


def test_edge_rows(spark):
    texts = [t for _, t in edge.TEXTS if t is None or len(t) < 5000]
    rows = quality(edge.documents(spark), keep=["doc_id", "text"], prefix="q_").collect()
    assert len(rows) == len(edge.TEXTS)
    for r in rows:
        if r["text"] is None or len(r["text"]) < 5000:
            want = brute(r["text"])
            assert {k: r["q_" + k] for k in want} == want
        else:
            assert r["q_n_words"] == len(r["text"].split(" ")) and not r["q_base_failed"]
    assert len(texts) > 5 and quality(edge.empty(spark)).count() == 0
