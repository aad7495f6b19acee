"""Operator 10: language-model scoring by cross-entropy difference.

A target and a background bigram model are matched in all but their documents: the same tokens, one vocabulary, the same smoothing, and the
same size, as the counts of the background, which are those of all documents, are scaled to as many tokens as the target has. Each document
is scored by models without it: its own counts are taken off those of all documents, and off the target's if it is in it. Its score is its
mean loss per token under the target model less that under the background: the lower, the more it is like the target.

Counts can be of any number of token pairs, so no task holds a whole model. Each task cuts its rows into blocks of about block_bytes of text,
and writes their tokens and the counts of their own pairs; the counts are added up by pair, and each block gets back the totals of just the
pairs that it holds, next to which its documents are scored. Blocks are cut by place, not by id, so ids that are null or that many rows share
make no large one.

Cases: null and empty texts are one end token; texts of any length are scored whole; rows of one id are documents of their own, all of them
target documents if the id is; rows without an id are none; without target documents all scores are 0; an empty table gives an empty one;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import as_bytes, ref, slices
from tidepool.llm.packing import tokens
from tidepool.runtime import ensure_workers, materialise


@dataclass(frozen=True)
class Settings:
    """prior_pair: how many tokens the single-token model counts as in a pair's context; prior_token: what is added to each token's count."""

    prior_pair: float = 20.0
    prior_token: float = 0.5
    block_bytes: int = 4 << 20


@dataclass
class Block:
    """Tokens of a block's documents end to end, each document closed by the end token, which also stands before its first, so that a token is
    a context as often as it occurs. Tokens are numbered by their place in `vocabulary`, and `token` are these numbers; `pairs` are the
    distinct pairs of neighbours, each token's (with the one before) at place `at`."""

    size: np.ndarray
    vocabulary: np.ndarray
    token: np.ndarray
    pairs: np.ndarray
    at: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    @property
    def keys(self) -> np.ndarray:
        """Of the pairs, and of the tokens of the vocabulary."""
        v, n = self.vocabulary.astype(np.int64), len(self.vocabulary)
        return np.concatenate([(v[self.pairs // n] + 1) << 32 | v[self.pairs % n], v])

    def before(self, values: np.ndarray) -> np.ndarray:
        """Of each token, the value of the one before it; of a document's first, that of its end token."""
        out = np.roll(values, 1)
        ends = np.cumsum(self.size)
        out[ends - self.size] = values[ends - 1]
        return out


#: Up to so many possible pairs, a pair is looked up in a table of all.
TABLE = 1 << 25


def _block(parts: list[bytes], width: str, end: int) -> Block:
    """Of the documents' tokens, the end token included."""
    each = np.dtype(width).itemsize
    size = np.array([len(p) // each for p in parts], np.int64)
    token = np.frombuffer(b"".join(parts), width)
    used = np.zeros(end + 1, bool)
    used[token] = True
    vocabulary = np.flatnonzero(used)
    number = np.zeros(end + 1, np.int64)
    number[vocabulary] = np.arange(len(vocabulary))
    token = number[token]
    block = Block(size, vocabulary, token, token, token)
    pair = block.before(token) * len(vocabulary) + token
    ordered = np.sort(pair)
    block.pairs = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
    if len(vocabulary) ** 2 <= TABLE:
        table = np.empty(len(vocabulary) ** 2, np.int32)
        table[block.pairs] = np.arange(len(block.pairs), dtype=np.int32)
        block.at = table[pair]
    else:
        block.at = np.searchsorted(block.pairs, pair).astype(np.int32)
    return block


def _tally(block: Block, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, count in chosen documents, count in all) of the block's pairs and tokens."""
    counts = []
    for held in (np.repeat(chosen, block.size), slice(None)):
        counts.append(np.concatenate([np.bincount(block.at[held], minlength=len(block.pairs)), np.bincount(block.token[held], minlength=len(block.vocabulary))]))
    return block.keys, counts[0], counts[1]


def _own(document: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
    """How often each token's kind occurs in its own document."""
    key = document * kinds + kind
    order = np.argsort(key)
    key = key[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(np.diff(edges), np.diff(edges))
    return out


def _losses(block: Block, counts: list[np.ndarray], totals: list[float], members: list[np.ndarray], scales: list[float], settings: Settings, vocabulary: int) -> list[np.ndarray]:
    """Mean loss of each document in each model, from the model's counts of the block's keys; members: documents to take off a model's counts."""
    document, n = block.document, len(block.pairs)
    own_pair, own_token = _own(document, block.at, n), _own(document, block.token, len(block.vocabulary))
    own_context, first = block.before(own_token), np.cumsum(block.size) - block.size
    out = []
    for count, total, member, scale in zip(counts, totals, members, scales):
        off, token = member[document], count[n:][block.token]
        context = block.before(token)
        single = (scale * (token - off * own_token) + settings.prior_token) / (scale * (total - member * block.size) + settings.prior_token * vocabulary)[document]
        each = (scale * (count[:n][block.at] - off * own_pair) + settings.prior_pair * single) / (scale * (context - off * own_context) + settings.prior_pair)
        out.append(np.add.reduceat(-np.log(each), first) / block.size)
    return out


def score(df: DataFrame, targets: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of df: id, n_tokens long, target_loss, background_loss and score double. targets: ids (id_col) of target documents."""
    ensure_workers(df.sparkSession)
    kind = df.schema[id_col].dataType
    docs = df.select(ref(id_col).cast("string").alias("id"), ref(text_col).cast("string").alias("text"))
    chosen = targets.select(ref(id_col).cast("string").alias("id")).where("id IS NOT NULL").distinct().withColumn("held", F.lit(True))
    # a merge join at every size: what it needs grows as the input does, and an id that many rows share can be split
    marked = docs.where("id IS NOT NULL").join(chosen.hint("merge"), "id", "left").select("id", F.coalesce("held", F.lit(False)).alias("held"), "text")
    marked = marked.unionByName(docs.where("id IS NULL").select("id", F.lit(False).alias("held"), "text"))
    end = len(tokens(tokenizer_path).tokenizer.get_vocab())
    width = "<u2" if end < 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of each block, then its counts."""
        model, close, number = tokens(tokenizer_path), np.array([end], width).tobytes(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in slices(batch, batch.column(2), settings.block_bytes) if batch.num_rows else ():
                parts = [np.frombuffer(model.encode(b.decode()), "<u4").astype(width).tobytes() + close for b in as_bytes(texts)]
                key, target, every = _tally(_block(parts, width, end), part.column(1).to_numpy(zero_copy_only=False))
                name, number = f"{task}:{number}", number + 1
                nothing = lambda n, kind: pa.nulls(n, kind)
                rows = {"block": pa.array([name] * len(parts)), "id": part.column(0), "held": part.column(1), "tokens": pa.array(parts, pa.binary())}
                yield pa.RecordBatch.from_pydict({**rows, **{c: nothing(len(parts), pa.int64()) for c in ("key", "target", "every")}})
                rows = {"block": pa.array([name] * len(key)), "id": nothing(len(key), pa.string()), "held": nothing(len(key), pa.bool_()), "tokens": nothing(len(key), pa.binary())}
                yield pa.RecordBatch.from_pydict({**rows, "key": pa.array(key), "target": pa.array(target), "every": pa.array(every)})

    blocks = materialise(marked.mapInArrow(cut, "block string, id string, held boolean, tokens binary, key long, target long, every long"), "blocks")
    counts = blocks.where("key IS NOT NULL")
    model = materialise(counts.groupBy("key").agg(F.sum("target").alias("target"), F.sum("every").alias("every")), "model")
    n = model.where(F.col("key") < (1 << 32)).agg(F.sum("target"), F.sum("every")).head()
    totals = [float(n[0] or 0), float(n[1] or 0)]
    scales = [1.0, totals[0] / max(totals[1], 1)]
    known = counts.select(F.col("block").alias("of"), "key").join(model, "key")

    def losses(_key: tuple, written: pa.Table, held: pa.Table) -> pa.Table:
        block = _block([p for c in written.column("tokens").chunks for p in c.to_pylist()], width, end)
        keys = held.column("key").to_numpy()
        order = np.argsort(keys)
        place = order[np.searchsorted(keys, block.keys, sorter=order)]
        member = written.column("held").to_numpy().astype(np.int64)
        target, every = _losses(block, [held.column(c).to_numpy()[place] for c in ("target", "every")], totals, [member, np.ones_like(member)], scales, settings, end + 1)
        return pa.table({"id": written.column("id"), "n_tokens": pa.array(block.size), "target_loss": pa.array(target), "background_loss": pa.array(every)})

    scored = blocks.where("tokens IS NOT NULL").select("block", "id", "held", "tokens").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(losses, "id string, n_tokens long, target_loss double, background_loss double")
    return scored.select(F.col("id").cast(kind).alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
