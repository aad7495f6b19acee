from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import edge

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidepool.llm.packing import Tokens, pack, pack_documents  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return t


def test_ids_equal_the_library(library):
    rng = random.Random(5)
    parts = ["é", "'s", "'LL", " ", "  ", "\n", "\t", "a", "B1", "½", "²", "—", "«", " !", "...", "中", "\x85", "\xa0", "\x1f", "<|endoftext|>", "'", "ſ", "µ", "_", "s", " ", "😀"]
    own = Tokens(PATH)
    assert own.table is not None
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randrange(25)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def laid_out(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int]]], int]:
    plan = pack(counts, capacity)
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    number = np.concatenate([np.arange(c) for c in counts.values()]) if counts else np.zeros(0, np.int64)
    bins = defaultdict(list)
    if len(length):
        for s, o, n in zip(*(x.tolist() for x in plan.place(length, number)), length.tolist()):
            bins[s].append((o, n))
    return bins, plan.sequences


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    """The same rules, piece by piece."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    room = []
    while large:
        a = large.pop(0)
        k = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        room.append(capacity - a - (large.pop(k) if k is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


def test_packing_is_gapless_and_equals_the_plain_rules():
    rng = random.Random(1)
    for _ in range(250):
        lengths = [rng.randint(1, 48) for _ in range(rng.randrange(120))]
        bins, n = laid_out(dict(Counter(lengths)), 48)
        assert len(bins) == n == plain_best_fit(lengths, 48)
        for b in bins.values():
            at = 0
            for o, size in sorted(b):
                assert o == at
                at += size
            assert at <= 48
        assert Counter(s for b in bins.values() for _, s in b) == Counter(lengths)


def test_packing_is_near_the_bound_and_the_plan_is_small():
    rng = random.Random(2)
    lengths = [min(1024, int(rng.expovariate(1 / 400)) + 1) for _ in range(60_000)]
    plan = pack(dict(Counter(lengths)), 1024)
    assert plan.sequences <= 1.01 * sum(lengths) / 1024 + 1 and len(plan.first) < 6000
    doubled = pack({n: 50 * c for n, c in Counter(lengths).items()}, 1024)
    assert len(doubled.first) < 6000
    assert pack({}, 1024).sequences == 0
    with pytest.raises(ValueError):
        pack({1025: 1}, 1024)


@pytest.mark.parametrize("with_ids", [False, True])
def test_edge_rows(spark, library, with_ids):
    rows = pack_documents(edge.documents(spark), PATH, with_ids=with_ids).collect()
    streams = Counter()
    for i, t in edge.TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        head = n if n <= 1024 else n % 1024 or 1024
        at = [0, *range(head, n + 1, 1024)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            streams[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == streams
    if with_ids:
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert pack_documents(edge.empty(spark), PATH).count() == 0
