"""Operator 6: best-fit packing with large-item matching.

Documents become tokens and an end id; longer ones than a sequence are cut, the first piece taking what full pieces leave over. Pieces over
a third of the capacity go at most two to a sequence, matched greedily from the longest down, each with the longest that still fits;
smaller ones fill the tightest gap that holds them, longest first, and open new sequences only when none does.

Packing looks at lengths only, and there are at most `capacity` of them: the driver gets one count per length, works out how many sequences
there are of each pattern of lengths, and sends that plan (bounded by the capacity, not by the data) back. Pieces of one length are
numbered through salted groups, so a length that a third of all documents share is dealt over many tasks.

Cases: a null text is an empty one, and an empty text is its end id alone; texts of any length are cut whole; repeated rows are pieces of
their own; ties in length go by id, piece and content; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import as_bytes, map_texts
from tidepool.runtime import ensure_workers, materialise

#: Letters, numbers and spaces among the characters that the fast path knows: ASCII without odd controls, Latin-1, Latin Extended-A and
#: general punctuation. Any other text goes to the tokenizer whole.
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t-\r\x20\xa0"
_odd = re.compile(r"[^\t-\r\x20-\x7e\xa0-\u017f\u2010-\u2027\u2030-\u205e]")
_word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
REMEMBER = 100_000
#: Pieces of one length that a task numbers together, about.
GROUP_ROWS = 2_000


class Tokens:
    """Ids of whole texts as little-endian bytes, by a byte-level BPE file of the tokenizers library.

    Texts of common characters are split into words as the file's pattern splits them, and each distinct word is encoded once, by a merge
    table with the file's own vocabulary where ids rise in the order of its merges (so that the lowest id is the first merge). A text that
    holds the literal of an added token, which the library takes for that token, goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = self._merge_table(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]

    @staticmethod
    def _merge_table(spec: dict):
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        byte_of = _byte_characters()
        if made != sorted(made) or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            return None
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in special}
        return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.table is None or _odd.search(text) or any(a in text for a in self.added):
            return self._ids(text)
        known, out = self.known, []
        if len(known) > REMEMBER:
            known.clear()
        for w in _word.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.table.encode_ordinary(w)
                ids = known[w] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(ids)
        return b"".join(out)


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(df: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece int, start long, length long, ids_crc32 long, and its ids array<long> if asked for."""
    one = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        one.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = struct.pack("<I", end_id)

    def make():
        model = tokens(tokenizer_path)

        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            count, cols = [], ([], [], [], [], [])
            for b in as_bytes(texts):
                data = memoryview(model.encode(b.decode()) + end)
                n = len(data) // 4
                head = n if n <= capacity else n % capacity or capacity
                edges = [0, *range(head, n + 1, capacity)]
                count.append(len(edges) - 1)
                for i, (x, y) in enumerate(zip(edges, edges[1:])):
                    part = data[4 * x : 4 * y]
                    for c, v in zip(cols, (i, x, y - x, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None)):
                        c.append(v)
            arrays = [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.list_(pa.int64())))
            whole = pa.StructArray.from_arrays(arrays, names=[f.name for f in one])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), whole)]

        return work

    done = map_texts(df, text_col, [id_col], [T.StructField("pieces_", T.ArrayType(T.StructType(one)))], make)
    return done.select(id_col, F.inline("pieces_"))


@dataclass
class Plan:
    """For each length, runs of its pieces by number: the run's first piece, how many of them a sequence takes, its first sequence, and the
    offset of the first of them there. Runs of all lengths stand end to end; of length l they are at[l] to at[l + 1]."""

    at: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and numbers."""
        big = np.int64(1) << 42
        lengths = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        k = np.searchsorted(lengths * big + self.first, length * big + number, side="right") - 1
        into = number - self.first[k]
        return self.sequence[k] + into // self.each[k], self.offset[k] + into % self.each[k] * length


def pack(counts: dict[int, int], capacity: int) -> Plan:
    """counts: how many pieces there are of each length from 1 to capacity."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []  # gaps that some sequence has, ascending

    def put(pattern: tuple[int, ...], many: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((pattern, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and large[k] == a and left[a] < 2:
            k -= 1
        if k < 0:
            put((a,), left.pop(a))
            large.pop()
            continue
        b = large[k]
        many = left[a] // 2 if a == b else min(left[a], left[b])
        put((a, b), many)
        for n in (a, b):
            left[n] -= many
        for n in {a, b}:
            if not left[n]:
                del left[n]
                large.remove(n)
    for small in sorted(left, reverse=True):
        rest = left[small]
        while rest:
            k = bisect_left(order, small)
            if k == len(order):
                each = capacity // small
                if rest >= each:
                    put((small,) * each, rest // each)
                if rest % each:
                    put((small,) * (rest % each), 1)
                break
            gap = order[k]
            pattern, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = gap // small
            full = min(many, rest // each)
            if full:
                put((*pattern, *(small,) * each), full)
                rest -= full * each
            if full < many and rest:
                put((*pattern, *(small,) * rest), 1) if rest < each else None
                used = full + (rest < each)
                rest = 0 if rest < each else rest
                if many > used:
                    put(pattern, many - used)
            elif full < many:
                put(pattern, many - full)
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    dealt = dict.fromkeys(counts, 0)
    sequence = 0
    for gap in sorted(gaps):
        for pattern, many in gaps[gap]:
            at = 0
            for n in dict.fromkeys(pattern):
                each = pattern.count(n)
                runs[n].append((dealt[n], each, sequence, at))
                dealt[n] += each * many
                at += each * n
            sequence += many
    flat = [r for n in range(capacity + 1) for r in runs.get(n, ())]
    at = np.concatenate([[0], np.cumsum([len(runs.get(n, ())) for n in range(capacity + 1)])]).astype(np.int64)
    cols = np.array(flat, np.int64).reshape(-1, 4)
    return Plan(at, cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], sequence)


def pack_documents(df: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id long, offset long."""
    ensure_workers(df.sparkSession)
    cut = materialise(pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    counts = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack(counts, capacity)
    salts = max(1, -(-sum(counts.values()) // GROUP_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    order = [id_col, "piece", "start", "ids_crc32"]
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    numbered = salted.withColumn("number", number).join(before, ["length", "salt"]).select(*cut.columns, (F.col("number") + F.col("before")).alias("number"))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return numbered.mapInArrow(place, schema)
