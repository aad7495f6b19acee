from __future__ import annotations

import math
from collections import Counter

import pytest

from tests.llm import edge

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidepool.llm.crossentropy import Settings, score  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, targets, settings=Settings()):
    t = tokenizers.Tokenizer.from_file(PATH)
    end = t.get_vocab_size()
    v = end + 1
    docs = [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]
    sums = []
    for chosen in (lambda i: i in targets, lambda i: True):
        pair, token = Counter(), Counter()
        for i, ids in docs:
            if chosen(i):
                pair.update(zip([end, *ids], ids))
                token.update(ids)
        sums.append((pair, token, sum(token.values())))
    out = []
    for i, ids in docs:
        loss = []
        for k, (pair, token, total) in enumerate(sums):
            # the document itself taken off, and the background scaled to the target's size
            off = k == 1 or i in targets
            own_pair, own_token = Counter(zip([end, *ids], ids)), Counter(ids)
            scale = sums[0][2] / sums[1][2] if k else 1.0
            x = 0.0
            for a, b in zip([end, *ids], ids):
                single = (scale * (token[b] - off * own_token[b]) + settings.prior_token) / (scale * (total - off * len(ids)) + settings.prior_token * v)
                x -= math.log((scale * (pair[a, b] - off * own_pair[a, b]) + settings.prior_pair * single) / (scale * (token[a] - off * own_token[a]) + settings.prior_pair))
            loss.append(x / len(ids))
        out.append((i, len(ids), *loss))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], rel=1e-9)


@pytest.mark.parametrize("block_bytes", [400, 8 << 20])
def test_against_plain_counts(spark, block_bytes):
    rows = [(i, edge.prose(i, 30)) for i in range(60)] + [(61, None), (62, "")]
    targets = {i for i in range(0, 60, 3)}
    labels = spark.createDataFrame([(i,) for i in [*targets, *targets, None, 999]], "doc_id bigint")
    got = score(edge.documents(spark, rows), labels, PATH, settings=Settings(block_bytes=block_bytes)).collect()
    same([(r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got], brute(rows, targets))
    assert all(r["score"] == r["target_loss"] - r["background_loss"] for r in got)


def test_target_documents_score_lower(spark):
    rows = [(i, " ".join([edge.WORDS[i % 40 + (0 if i % 2 else 500)]] * 3 + [edge.prose(i, 5)])) for i in range(300)]
    labels = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id bigint")
    by = {r["doc_id"]: r["score"] for r in score(edge.documents(spark, rows), labels, PATH).collect()}
    new = [by[i] for i in range(201, 300, 2)]
    other = [by[i] for i in range(200, 300, 2)]
    assert sum(new) / len(new) < sum(other) / len(other)


def test_repeated_and_missing_ids_make_no_large_block(spark):
    """Half of the rows have no id, a quarter share one, which is a target's."""
    rows = [(None if i % 2 else 7 if i % 4 else i, edge.prose(i % 50, 20)) for i in range(400)] + [(1000, "<|endoftext|> as a literal")]
    labels = spark.createDataFrame([(7,), (8,), (1000,)], "doc_id bigint")
    df = edge.documents(spark, rows)
    got = score(df, labels, PATH, settings=Settings(block_bytes=2000)).collect()
    same([(r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got], brute(rows, {7, 8, 1000}))


def test_documents_that_occur_twice_stand_out(spark):
    """Their other copy is part of the background, they themselves are not."""
    rows = [(i, edge.prose(i if i >= 40 else i // 2, 120)) for i in range(400)]
    labels = spark.createDataFrame([(i,) for i in range(41, 400, 2)], "doc_id bigint")
    by = {r["doc_id"]: r["background_loss"] for r in score(edge.documents(spark, rows), labels, PATH).collect()}
    alone = sorted(by[i] for i in range(40, 400))
    assert sum(by[i] < alone[36] for i in range(40)) >= 36


def test_edge_rows(spark):
    labels = spark.createDataFrame([(5,)], "doc_id bigint")
    got = score(edge.documents(spark), labels, PATH).collect()
    same([(r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got], brute(edge.TEXTS, {5}))
    none = labels.where("false")
    assert [r["score"] for r in score(edge.documents(spark), none, PATH).collect()] == [0.0] * len(edge.TEXTS) and score(edge.empty(spark), labels, PATH).count() == 0
