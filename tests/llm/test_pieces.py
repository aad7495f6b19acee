from __future__ import annotations

import random
import struct

import pytest

from tests.llm import edge

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidepool.llm.pieces import CharMap, Codec, decode_ids, encode_texts  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    fixed = ["", " ", "   ", "a", "▁", " ▁a ▁▁ b", "\n\n x\n", "<s> </s> <unk> <0x0A>", "日本語 テスト", "\x00a\x00", "é" * 50, "\u0085a b", "𝔘𝔫𝔦  ", " lead", "trail  ", "x" * 5000]
    return fixed + ["".join(rng.choices("ab ▁\n\tthe é中😀eritonS.,", k=rng.randrange(40))) for _ in range(1500)]


def test_equals_the_library(both):
    codec, library = both
    for t in texts():
        want = library.encode(t)
        ids, begins, ends, decoded = codec.encode(t)
        assert ids.tolist() == want
        assert decoded == library.decode(want) == codec.decode(want)


def test_spans_tile_the_source(both):
    codec, _ = both
    for t in texts():
        ids, begins, ends, _ = codec.encode(t)
        if len(ids):
            assert begins[0] == 0 and ends[-1] == len(t.encode())
            assert (begins[1:] == ends[:-1]).all()
            data = t.encode()
            for i, b, e in zip(ids, begins, ends):
                if codec.types[i] == 1 and "▁" not in t:
                    shown = codec.pieces[i].replace("▁", " ")
                    assert data[b:e].decode() == (shown if b or not shown.startswith(" ") or data[b:e].decode() == shown else shown[1:])


def library_spans(library, text):
    """(first source byte, the byte after the last) of each piece, by the library."""
    from sentencepiece import sentencepiece_pb2

    found = sentencepiece_pb2.SentencePieceText()
    found.ParseFromString(library.encode(text, out_type="serialized_proto"))
    return [(p.begin, p.end) for p in found.pieces]


def test_spans_equal_the_library(both):
    codec, library = both
    for t in texts():
        _, begins, ends, _ = codec.encode(t)
        assert list(zip(begins.tolist(), ends.tolist())) == library_spans(library, t)


def test_the_vectorised_record_equals_the_general_one(both):
    codec, _ = both
    general = Codec(PATH)
    general.identity = False
    for t in texts():
        (one, a), (two, b) = codec.normalise(t), general.normalise(t)
        assert one == two and a.tolist() == b.tolist()


def test_long_chunks_merge_alike(both):
    codec, library = both
    rng = random.Random(5)
    for n in (49, 50, 300, 2000):
        t = "".join(rng.choices("theritons", k=n))
        assert codec.encode(t)[0].tolist() == library.encode(t)


def char_map(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map, its double array built one node at a time."""
    targets, places = b"", {}
    for v in entries.values():
        if v not in places:
            places[v] = len(targets)
            targets += v + b"\0"
    trie: dict = {}
    for k, v in entries.items():
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[None] = places[v]
    units, used = {0: 0}, {0}

    def place(node: dict, at: int) -> None:
        labels = [0 if c is None else c for c in node]
        offset = 1
        while any((at ^ offset ^ c) in used for c in labels) or offset >= 1 << 21:
            offset += 1
        base = at ^ offset
        used.update(base ^ c for c in labels)
        units[at] = units.get(at, 0) | offset << 10 | (256 if None in node else 0)
        for c, child in node.items():
            if c is None:
                units[base] = child | 1 << 31
            else:
                units[base ^ c] = c
                place(child, base ^ c)

    place(trie, 0)
    size = -(-(max(units) + 257) // 256) * 256
    blob = struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)])
    return struct.pack("<I", len(blob)) + blob + targets


MAP = {"ﬁ".encode(): b"fi", "é".encode(): b"e", b"ab": b"X", b"abc": b"the", " ".encode(): b" ", "½".encode(): " 1/2".encode(), b"\t": b" "}


def test_longest_prefix_of_the_map():
    m = CharMap(char_map(MAP))
    assert m.longest(b"abcd", 0) == (3, b"the") and m.longest(b"abd", 0) == (2, b"X") and m.longest(b"a", 0) is None and m.longest(b"zab", 1) == (2, b"X")


@pytest.mark.parametrize("squeeze", [False, True])
def test_mapped_normalisation_equals_the_library(squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.precompiled_charsmap = char_map(MAP)
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    data = proto.SerializeToString()
    codec, library = Codec(proto=data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(9)
    for t in ["", "   ", "abc ab a", "ﬁne  café", "½", " \t x \t ", *["".join(rng.choices("abc ﬁé½\t the", k=rng.randrange(30))) for _ in range(600)]]:
        ids, begins, ends, decoded = codec.encode(t)
        want = library.encode(t)
        assert ids.tolist() == want
        assert decoded == library.decode(want)
        assert list(zip(begins.tolist(), ends.tolist())) == library_spans(library, t)


def test_operator_on_edge_rows(spark, both):
    _, library = both
    rows = encode_texts(edge.documents(spark), PATH).collect()
    want = sorted((str(i), library.encode(t or "")) for i, t in edge.TEXTS)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == want
    back = decode_ids(encode_texts(edge.documents(spark), PATH), PATH).collect()
    assert sorted(r["decoded"] for r in back) == sorted(library.decode(library.encode(t or "")) for _, t in edge.TEXTS)
    assert encode_texts(edge.empty(spark), PATH).count() == 0
