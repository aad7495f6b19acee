"""Operator 1: SentencePiece encoding and decoding that keeps source offsets.

Normalisation reads the longest prefix from the model's compiled character map and records, for every byte it writes, the source byte
it came from. Pieces are found in the normalised text, then projected through that record to byte spans of the original.

The normalised text is cut where no piece of the vocabulary can reach across (before a space mark, and around characters that only ever
stand alone), so equal chunks always encode alike and each distinct short chunk of a task is merged once. Of a character that falls back to
bytes the last byte's piece spans it, those before are empty. The decoded text is that of the whole id sequence.

Cases: a null text is an empty one; an empty text has no pieces and decodes to ''; texts of any length are encoded whole; repeated rows
are encoded alike; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import as_bytes, list_array, map_texts
from tidepool.runtime import ensure_workers

MARK = "▁"
WORST = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_TEXT = " ⁇ "
#: Chunks of at most so many characters are remembered in a task, so many of them; beyond that the memory starts anew (results stay the same).
REMEMBER, REMEMBER_LENGTH = 400_000, 256


#: Latin, Greek and Cyrillic letters, and what is neither letter, digit nor mark in any script.
_letter, _sign = re.compile("[A-Za-zÀ-ÖØ-öø-ɏΑ-ЯЀ-ӿ]"), re.compile(r"\W")


class CharMap:
    """The compiled character map: a double-array trie over source bytes whose values point into a block of zero-ended targets."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, target) of the longest entry that data has at `at`."""
        units, found = self.units, None
        node = self._child(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node = node ^ self._child_of(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.targets[found[1] : self.targets.index(0, found[1])]

    def _child(self, node: int) -> int:
        return node ^ self._child_of(self.units[node])

    @staticmethod
    def _child_of(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    """Encodes and decodes as one model file says. BPE models are supported."""

    def __init__(self, path: str | None = None, *, proto: bytes | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models can be encoded")
        spec = model.normalizer_spec
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.fallback = model.trainer_spec.byte_fallback
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.user = sorted((p.piece for p in model.pieces if p.type == USER), key=len, reverse=True)
        long = [p for p, i in self.ids.items() if len(p) > 1]
        if UNUSED in self.types:
            raise ValueError("models with unused pieces can't be encoded")
        joins = any(a != MARK and b == MARK for p in long for a, b in zip(p, p[1:]))
        within = {c for p in long for c in p}
        lone = "" if "\n" in within else "\n"
        space = f"{MARK} " if self.escape else MARK
        #: Normalisation rewrites nothing but spaces, and begins the text with a mark.
        self.identity = self.map is None and not self.squeeze and not self.user and self.escape and self.prefix and not self.suffix
        self.surface = [self._surface([i]) if t != BYTE else chr(int(p[3:5], 16)) for i, (p, t) in enumerate(zip(self.pieces, self.types))]
        #: Ids whose bytes mean something only together with their neighbours.
        self.partial = np.array([t == BYTE and int(p[3:5], 16) > 127 for p, t in zip(self.pieces, self.types)])
        # bytes of normalised text that an id stands for
        self.width = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)], np.int64)
        self.join_score = {p: self.scores[i] for p, i in self.ids.items() if len(p) > 1}
        # a letter ends its chunk before a sign where no piece has a letter and a sign in a row
        ends = not any(_letter.match(a) and _sign.match(b) and b != MARK for p in long for a, b in zip(p, p[1:]))
        word = f"[{space}]*{_letter.pattern}+(?=[^\\w{space}])|" if ends else ""
        self.cut = re.compile(f"{word}[{space}]*[^{space}{lone}]+|[{space}]+|{lone or '(?!)'}+" if not joins and not self.user else "(?s).+")
        self.known: dict[str, bytes] = {}

    # -- normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, for each of its bytes and its end where the source characters begin that it came from)."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.identity:
            return MARK + text.replace(" ", MARK), self._unchanged(data)
        out, source, n = bytearray(), [], len(data)
        mark = MARK.encode() if self.escape else b" "

        def next_part(at: int) -> tuple[int, bytes]:
            for u in self.user:
                if data.startswith(u.encode(), at):
                    return len(u.encode()), u.encode()
            if self.map and (hit := self.map.longest(data, at)):
                return hit
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return size, data[at : at + size]

        def put(what: bytes, at: int) -> None:
            out.extend(what)
            source.extend([at] * len(what))

        at = 0
        while self.squeeze and at < n:
            size, part = next_part(at)
            if part != b" ":
                break
            at += size
        if at == n:
            return "", np.array([n])
        if self.prefix and not self.suffix:
            put(mark, at)
        was_space = self.squeeze
        while at < n:
            size, part = next_part(at)
            while was_space and part.startswith(b" "):
                part = part[1:]
            if part:
                for c in part:
                    put(mark if c == 0x20 else bytes([c]), at)
                was_space = part.endswith(b" ")
            at += size
            if not self.squeeze:
                was_space = False
        end = n
        while self.squeeze and out.endswith(mark):
            end = source[-len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
        if self.prefix and self.suffix:
            put(mark, end)
        return out.decode("utf-8", "replace"), np.array([*source, end], np.int64)

    @staticmethod
    def _unchanged(data: bytes) -> np.ndarray:
        """The record of a normalisation that puts a mark first and one in place of each space."""
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(len(raw))
        if not data.isascii():
            at[raw & 0xC0 == 0x80] = 0
            np.maximum.accumulate(at, out=at)
        return np.concatenate([np.zeros(3, np.int64), np.repeat(at, np.where(raw == 0x20, 3, 1)), [len(raw)]])

    # -- pieces of a normalised chunk

    def merge(self, chunk: str) -> list[str]:
        """Joins neighbours, best score first and leftmost among equals, until no joined pair is in the vocabulary."""
        part = self._split(chunk)
        if len(part) > 48 or self.user:
            return self._merge_long(part)
        get = self.join_score.get
        score = [get(a + b, WORST) for a, b in zip(part, part[1:])]
        while score:
            best = max(score)
            if best == WORST:
                break
            at = score.index(best)
            part[at] += part.pop(at + 1)
            del score[at]
            if at < len(score):
                score[at] = get(part[at] + part[at + 1], WORST)
            if at:
                score[at - 1] = get(part[at - 1] + part[at], WORST)
        return part

    def _merge_long(self, part: list[str]) -> list[str]:
        """The same with a heap, for chunks of any length."""
        get = self.join_score.get
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []
        fixed = {i for i, p in enumerate(part) if p in self.user} if self.user else ()

        def offer(a: int, b: int) -> None:
            score = get(part[a] + part[b])
            if score is not None and a not in fixed and b not in fixed:
                heapq.heappush(heap, (-score, a, b, len(part[a]) + len(part[b])))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not part[a] or not part[b] or right[a] != b or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [p for p in part if p]

    def _split(self, chunk: str) -> list[str]:
        if not self.user:
            return list(chunk)
        return re.findall("|".join([*map(re.escape, self.user), "(?s:.)"]), chunk)

    def to_ids(self, pieces: list[str]) -> list[tuple[int, int]]:
        """(id, bytes of normalised text) of each piece; one unknown to the vocabulary goes to its bytes, or to the unknown id."""
        out: list[tuple[int, int]] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append((i, len(p.encode())))
            elif self.fallback:
                out += [(self.bytes[b], 1) for b in p.encode()]
            elif out and out[-1][0] == self.unknown:
                out[-1] = self.unknown, out[-1][1] + len(p.encode())
            else:
                out.append((self.unknown, len(p.encode())))
        return out

    # -- whole texts

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """(ids, first source byte and the byte after the last of each piece, decoded text)."""
        normal, source = self.normalise(text)
        if self.fallback:
            ids = np.frombuffer(b"".join(self._chunks(normal)), "<i4")
            ends = np.cumsum(self.width[ids])
        else:
            ids, ends = self._with_unknown(normal)
        edges = source[np.concatenate([[0], ends])] if len(ids) else np.zeros(1, np.int64)
        return ids, edges[:-1], edges[1:], self.decode(ids)

    def _chunks(self, normal: str) -> list[bytes]:
        """The ids of each chunk of a normalised text, as little-endian ints."""
        known, out = self.known, []
        if len(known) > REMEMBER:
            known.clear()
        for c in self.cut.findall(normal):
            got = known.get(c)
            if got is None:
                ids = [i for i, _ in self.to_ids(self.merge(c))]
                got = pack(f"<{len(ids)}i", *ids)
                if len(c) <= REMEMBER_LENGTH:
                    known[c] = got
            out.append(got)
        return out

    def _with_unknown(self, normal: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each ends in the normalised text) for a model without bytes: unknown pieces in a row are one, across chunks too."""
        ids: list[tuple[int, int]] = []
        for chunk in self.cut.findall(normal):
            for i, size in self.to_ids(self.merge(chunk)):
                if i == self.unknown and ids and ids[-1][0] == i:
                    ids[-1] = i, ids[-1][1] + size
                else:
                    ids.append((i, size))
        return np.array([i for i, _ in ids], np.int32), np.cumsum([n for _, n in ids], dtype=np.int64)

    def _surface(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind == UNKNOWN:
                out.append(UNKNOWN_TEXT)
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: the space that stands before the first piece goes, bytes that aren't UTF-8 become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        listed = ids.tolist()
        text = self._surface(listed) if self.partial[ids].any() else "".join([self.surface[i] for i in listed])
        if text[:1] == " " and (self.prefix or self.squeeze):
            first = next((i for i in listed if self.types[i] != CONTROL), None)
            if first is not None and self.types[first] in (NORMAL, USER) and self.pieces[first].startswith(MARK):
                text = text[1:]
        return text


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (4, 3, 2, 1):
                try:
                    c = data[at : at + size].decode()
                except UnicodeDecodeError:
                    continue
                if len(c) == 1 and at + size <= len(data):
                    out.append(c)
                    at += size
                    break
            else:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, then ids array<int>, begins and ends array<int> (the source bytes of each piece), decoded string."""
    i4 = T.ArrayType(T.IntegerType(), False)
    fields = [T.StructField("ids", i4), T.StructField("begins", i4), T.StructField("ends", i4), T.StructField("decoded", T.StringType())]

    def make():
        model = codec(model_path)

        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            done = [model.encode(b.decode()) for b in as_bytes(texts)]
            counts = np.array([len(d[0]) for d in done], np.int64)
            cat = lambda k: np.concatenate([d[k] for d in done]).astype(np.int32) if done else np.zeros(0, np.int32)
            return [list_array(counts, cat(0)), list_array(counts, cat(1)), list_array(counts, cat(2)), pa.array([d[3] for d in done], pa.string())]

        return work

    return map_texts(df, text_col, [id_col], fields, make, limit=1 << 20)


def decode_ids(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: its id and the text of its ids (null ids: null)."""
    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        model = codec(model_path)
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    ensure_workers(df.sparkSession)
    return df.select(id_col, texts(ids_col).alias("decoded"))
