"""Operator 2: near-duplicates by DartMinHash signatures and banded joins.

A document is the set of its five-word shingles, each of weight 1 however often it occurs, as similarity is that of the plain sets (the
signatures take any weights). For every shingle and every slab of the weight axis, hashed darts arrive one after another along a rank axis, each with a height in the slab and a coordinate of the
signature; those under the shingle's weight hit, and every coordinate keeps its earliest hit. All documents that hold a shingle see the same
darts, so two signatures agree in a coordinate as often as their weighted sets do. A document needs about k ln k + 2k darts however long it
is: the rank up to which it looks falls as its weight grows, and is doubled for documents that still lack a coordinate.

Rows are numbered as they are written to the shared folder; the nodes of all that follows are these numbers, so ids may be of any type that
can be ordered, be null or occur more than once.

Signatures are cut in bands; documents with an equal band share a bucket. A bucket never makes all its pairs: its centre, the member that
shares most with others, is compared with the other members, and pairs that hold (exact Jaccard similarity of the sets of shingles) join
components. Where members of a bucket are still in different components, its next two centres are compared with those outside their own
components, then its next four, and so on until such centres link nothing more. Buckets of a few members are compared pair by pair. What
the centres leave apart is compared too: buckets that overlap form a crowd, whose members are dealt in blocks, and in every two blocks all
pairs of different components are compared, but for those whose sizes or rarest shingles show that they can't be alike.

Cases: copies of one word sequence are one node from the start, so they cost one row each; null and wordless texts are classes of their
own; texts of one to four words only match their copies; every row is judged by its own text, so rows with one id and different texts can be
of different classes; rows without an id take part, and a class is named by its smallest id that isn't null (null if it has none); texts of
any length are read whole; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import as_bytes, list_array, map_texts, ref
from tidepool.llm.components import components
from tidepool.runtime import discard, materialise


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. similarity: least Jaccard similarity of a link. bands x rows: coordinates of a signature. With 48 bands of 6 a
    pair at 0.8 shares no bucket five times in ten million. small: members up to which a bucket is compared pair by pair at once."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 48
    rows: int = 6
    small: int = 6


_U = np.uint64
_RANK_ONE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _waits() -> np.ndarray:
    """Exponential waiting times in whole 2^-20ths: sums of them are the same on every machine."""
    return np.rint(-np.log((np.arange(65536) + 0.5) / 65536) * _RANK_ONE).astype(np.int64)


#: Word hashes that a worker keeps at most.
REMEMBER = 100_000


class Words(dict):
    """Hash of each word; as many as REMEMBER are kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBER:
            self[word] = h
        return h


def shingles(texts: list[bytes], words: int, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each distinct shingle, its hash, its count, words of each document, hash of each word end to end), by document and hash."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    h = np.fromiter((known[w] for ws in split for w in ws), _U, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    if len(h) < words:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), n, h
    rolled = h[: len(h) - words + 1] * _U(3)
    for k in range(1, words):
        rolled = mix(rolled) + h[k : len(h) - words + 1 + k] * _U(2 * k + 3)
    rolled = mix(rolled)
    inside = doc[: len(rolled)] == doc[words - 1 :]
    rolled, at = rolled[inside], doc[: len(inside)][inside]
    order = np.argsort(rolled)
    order = order[np.argsort(at[order].astype(np.uint16) if len(texts) < 65536 else at[order], kind="stable")]
    rolled, at = rolled[order], at[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return at[first], rolled[first], np.diff(np.append(first, len(rolled))), n, h


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """One row of k values per document: the earliest dart of each coordinate; documents without elements get the largest value."""
    none = np.iinfo(np.int64).max
    out = np.full((n_docs, k), none, np.int64)
    total = np.bincount(doc, weight, n_docs)
    reach = np.zeros(n_docs, np.int64)
    some = total > 0
    reach[some] = np.maximum(1, np.ceil((k * np.log(k) + 2 * k) * _RANK_ONE / total[some])).astype(np.int64)
    todo = some
    while todo.any():
        pick = todo[doc]
        _throw(doc[pick], element[pick], weight[pick], reach, out, k)
        todo = some & (out == none).any(1)
        reach[todo] *= 2
        out[todo] = none
    return out


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, out: np.ndarray, k: int) -> None:
    waits, flat = _waits(), out.reshape(-1)
    low, slab = 0.0, 0
    live = np.arange(len(doc))
    while len(live):
        high = max(1.0, 2 * low)
        width = int(high - low)
        at, seed = live, mix(element[live] + _U((slab * 0xD6E8FEB86659FD93) & (2**64 - 1)))
        rank = np.zeros(len(at), np.int64)
        limit = reach[doc[at]]
        whole = weight[at] >= high
        step = 0
        while len(at):
            step += 1
            hit = mix(seed + _U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            rank = rank + waits[hit >> _U(48)] // width
            on = rank <= limit
            at, seed, rank, limit, whole, hit = at[on], seed[on], rank[on], limit[on], whole[on], hit[on]
            height = (mix(hit) >> _U(40)).astype(np.float64) * (width / 2**24) + low
            strike = whole | (height < weight[at])
            coordinate = ((hit >> _U(28)) & _U(0xFFFFF)) * _U(k) >> _U(20)
            key = (np.minimum(rank, (1 << 41) - 1) << 22) | (hit & _U(0x3FFFFF)).astype(np.int64)
            place = doc[at] * k + coordinate.astype(np.int64)
            np.minimum.at(flat, place[strike], key[strike])
        live = live[weight[live] > high]
        low, slab = high, slab + 1


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(_U)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U))[None, :], parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + parts[:, :, r])
    return key.view(np.int64)


SIGNED = [
    T.StructField("words_hash", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType(), False)),
]


def sign(df: DataFrame, settings: Settings, keep: list[str], text_col: str) -> DataFrame:
    """One row per row: `keep`, words_hash (of the word sequence; null without words), keys (one per band; none below a shingle)."""

    def make():
        known = Words()

        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            whole = as_bytes(texts)
            doc, element, _, n, _ = shingles(whole, settings.words, known)
            values = signatures(doc, element, np.ones(len(doc)), len(whole), settings.bands * settings.rows)
            full = n >= settings.words
            keys = band_keys(values[full], settings.bands, settings.rows)
            digest = [xxhash.xxh3_128_digest(b" ".join(t.split())) if x else None for t, x in zip(whole, n)]
            return [pa.array(digest, pa.binary()), list_array(full * settings.bands, keys.reshape(-1))]

        return work

    return map_texts(df, text_col, keep, SIGNED, make, limit=1 << 20)


def shingle_sets(df: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """One row per row: id, grams array<long> (its distinct shingles)."""

    def make():
        known = Words()

        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            doc, element, _, n, _ = shingles(as_bytes(texts), settings.words, known)
            return [list_array(np.bincount(doc, minlength=len(n)), element.view(np.int64))]

        return work

    return map_texts(df, text_col, [id_col], [T.StructField("grams", T.ArrayType(T.LongType(), False))], make, limit=1 << 20)


def _buckets(members: DataFrame, most: int) -> DataFrame:
    """(key, n, hs) of the buckets of members (key, node, label, weight) that hold different labels: how many members, and the `most` heaviest.

    Written, so that joining members with it deals both sides anew, and a bucket that holds a third of all members can be split.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "node"))
    heads = members.withColumn("place", place).where(F.col("place") <= most).groupBy("key").agg(F.collect_list(F.struct("node", "label", "place")).alias("hs"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    return materialise(sizes.join(heads, "key").select("key", "n", "hs"), "buckets")


def _pairs(each: DataFrame, centres: int, small: int) -> DataFrame:
    """(key, a, b) to compare next, from members with their buckets.

    In buckets of at most `small` members all those with different labels are paired. In others the `centres` heaviest members are paired
    with the members of other labels: a node that shares many large buckets lies in the middle of its crowd, so most links go through it.
    """
    chosen = F.filter("hs", lambda h: (h["label"] != F.col("label")) & F.when(F.col("n") <= small, h["node"] > F.col("node")).otherwise(h["place"] <= centres))
    pairs = each.select("key", "node", F.explode(F.transform(chosen, lambda h: h["node"])).alias("with"))
    return pairs.select("key", F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b"))


def _rest(each: DataFrame, centres: int, small: int) -> DataFrame:
    """Members, without the centres just compared, of buckets too large to be settled by that."""
    centre = F.exists("hs", lambda h: (h["node"] == F.col("node")) & (h["place"] <= centres))
    return each.where((F.col("n") > small) & ~centre).select("key", "node", "weight")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have at least this Jaccard similarity."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    size = lambda c: F.size(c).cast("double")
    # sets whose sizes differ too much can't be alike
    both = both.where(F.least(size("ga"), size("gb")) >= similarity * F.greatest(size("ga"), size("gb")))
    same = both.select("a", "b", (size("ga") + size("gb")).alias("total"), size(F.array_intersect("ga", "gb")).alias("n"))
    return same.where(F.col("n") >= similarity * (F.col("total") - F.col("n"))).select("a", "b")


#: Shingles of a block; of texts longer than that, each is a block.
BLOCK = 200_000


def blocks(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(crowd, rung, block, node, label, size) of apart (key, node, label): crowds of overlapping buckets, in blocks of about BLOCK shingles.

    Sizes that can be alike are on one rung or on two next to each other, and the members of a rung are dealt to its blocks by a hash. Labels that
    fill a block have blocks of their own, which needn't be compared with each other.
    """
    # a bucket's hub is its smallest node, a node's hub the smallest of its buckets': what is left to connect is hubs that share a bucket
    hubs = apart.groupBy("key").agg(F.min("node").alias("hub"))
    near = materialise(apart.join(hubs.hint("merge"), "key").groupBy("node").agg(F.min("hub").alias("hub")), "hubs")
    held = materialise(apart.join(near.hint("merge"), "node").select("key", "hub").distinct(), "held")
    lowest = held.groupBy("key").agg(F.min("hub").alias("low"))
    edges = materialise(held.join(lowest.hint("merge"), "key").where("hub != low").select(F.col("hub").alias("a"), F.col("low").alias("b")).distinct(), "edges")
    crowds = components(edges)
    own = near.join(crowds.select(F.col("v").alias("hub"), F.col("label").alias("top")), "hub", "left").select("node", F.coalesce("top", "hub").alias("crowd"))
    members = apart.select("node", "label").distinct().join(own, "node")
    rung = F.floor(F.log(F.greatest("size", F.lit(1))) / -np.log(similarity - 1e-6)).cast("int") if similarity < 1 else F.col("size").cast("int")
    members = members.join(sets.select(F.col("id").alias("node"), F.size("grams").cast("long").alias("size")), "node").withColumn("rung", rung)
    members = materialise(members, "crowds")
    discard(near, held, edges, crowds)
    large = members.groupBy("crowd", "rung", "label").agg(F.sum("size").alias("total")).where(F.col("total") > BLOCK).select("crowd", "rung", "label", F.col("label").alias("own"))
    placed = members.join(large, ["crowd", "rung", "label"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    totals = placed.groupBy("crowd", "rung", "own").agg(F.ceil(F.sum("size") / BLOCK).alias("many"))
    dealt = placed.join(totals, ["crowd", "rung", "own"]).withColumn("part", F.pmod(F.xxhash64("node"), "many"))
    out = materialise(dealt.select("crowd", "rung", F.concat_ws(":", "crowd", "rung", "own", "part").alias("block"), "node", "label", "size"), "blocks")
    discard(members)
    return out


def block_links(node: np.ndarray, label: np.ndarray, right: np.ndarray, offsets: np.ndarray, grams: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the labels of documents: between those left and right, or among the left ones if none is right.

    Sets with this similarity share at least that share of the larger one, so one of the rarest shingles of both is common to both.
    """
    size = np.diff(offsets)
    order = np.lexsort((node, size, right))
    label, right, node = label[order], right[order], node[order]
    _, token, df = np.unique(grams, return_inverse=True, return_counts=True)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(rank, size)
    size = size[order]
    by = np.lexsort((token, df[token], doc))
    token, doc = token[by], doc[by]
    start = np.concatenate([[0], np.cumsum(size)])
    rare = np.arange(len(token)) - start[doc] < (size - np.ceil(similarity * size - 1e-9) + 1)[doc]
    rare &= df[token] > 1
    rare_token, rare_doc = token[rare], doc[rare]
    rare_start = np.searchsorted(rare_doc, np.arange(len(order) + 1))
    n_left = int((~right).sum())
    _, root = np.unique(label, return_inverse=True)
    mark = np.zeros(len(df), bool)
    out = []
    for a in range(n_left):
        base = n_left if n_left < len(order) else 0
        lo = max(base + int(np.searchsorted(size[base:], similarity * size[a] - 1e-6)), a + 1)
        hi = base + int(np.searchsorted(size[base:], size[a] / similarity + 1e-6, side="right"))
        mine = rare_token[rare_start[a] : rare_start[a + 1]]
        if lo >= hi or not len(mine):
            continue
        mark[mine] = True
        met = np.zeros(hi - lo, bool)
        met[rare_doc[rare_start[lo] : rare_start[hi]][mark[rare_token[rare_start[lo] : rare_start[hi]]]] - lo] = True
        mark[mine] = False
        near = lo + np.flatnonzero(met & (root[lo:hi] != root[a]))
        if not len(near):
            continue
        mine = token[start[a] : start[a + 1]]
        mark[mine] = True
        if 4 * len(near) > near[-1] - near[0]:
            span = mark[token[start[near[0]] : start[near[-1] + 1]]]
            n = np.add.reduceat(span, start[near[0] : near[-1] + 1] - start[near[0]], dtype=np.int64)[near - near[0]]
        else:
            n = np.array([np.count_nonzero(mark[token[start[b] : start[b + 1]]]) for b in near])
        mark[mine] = False
        for b in near[n >= similarity * (size[a] + size[near] - n)].tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                out.append((int(node[a]), int(node[b])))
    return out


def _crowd_links(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the different labels of each crowd: all its pairs of different labels are compared."""
    placed = blocks(apart, sets, similarity)
    each = placed.groupBy("crowd", "rung", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    each = materialise(each, "each")
    x, y = (each.select("crowd", "rung", *(F.col(c).alias(f"{c}_{s}") for c in ("rung", "block", "least", "most", "lo", "hi"))) for s in "xy")
    # of two blocks the one on the lower rung, or of one rung the one that sorts first, stands left
    x = x.withColumn("rung", F.explode(F.array("rung", F.col("rung") + 1)))
    first = (F.col("rung_x") < F.col("rung_y")) | ((F.col("rung_x") == F.col("rung_y")) & (F.col("block_x") <= F.col("block_y")))
    near = (F.col("least_x") * similarity <= F.col("most_y") + 1e-6) & (F.col("least_y") * similarity <= F.col("most_x") + 1e-6)
    apart_ = F.least("lo_x", "lo_y") != F.greatest("hi_x", "hi_y")
    pairs = x.join(y, ["crowd", "rung"]).where(first & near & apart_).select("block_x", "block_y")
    pairs = materialise(pairs.withColumn("pair", F.concat_ws("|", "block_x", "block_y")), "blockpairs")
    sides = pairs.select(F.col("block_x").alias("block"), "pair", F.lit(False).alias("right"))
    sides = sides.unionByName(pairs.where("block_x != block_y").select(F.col("block_y").alias("block"), "pair", F.lit(True).alias("right")))
    filled = materialise(placed.join(sets.select(F.col("id").alias("node"), "grams"), "node").select("block", "node", "label", "grams"), "filled")
    n = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filled.join(sides, "block").repartition(n, "pair")

    def compare(part: pa.Table) -> pa.Table:
        lists = part.column("grams").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        column = lambda c: part.column(c).to_numpy()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = block_links(column("node"), column("label"), column("right").astype(bool), offsets - offsets[0], lists.flatten().to_numpy(), similarity)
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    found = materialise(dealt.groupBy("pair").applyInArrow(compare, "a bigint, b bigint"), "links")
    discard(placed, each, pairs, filled)
    return found


def classes(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, id, copy_of, label) of a written table (row long, id, text): label is the number of one row of the class, copy_of the smallest id
    with the same words."""
    signed = materialise(sign(docs, settings, ["row", "id"], "text"), "signed")
    # written, so that the join deals both sides anew and a large group of copies can be split
    firsts = materialise(signed.where("words_hash IS NOT NULL").groupBy("words_hash").agg(F.min("row").alias("node"), F.min("id").alias("copy_of")), "firsts")
    copies = signed.join(firsts, "words_hash").select("row", "id", "node", "copy_of", F.when(F.col("row") == F.col("node"), F.col("keys")).alias("keys"))
    copies = copies.unionByName(signed.where("words_hash IS NULL").select("row", "id", F.col("row").alias("node"), F.col("id").alias("copy_of"), F.lit(None).cast("array<bigint>").alias("keys")))
    copies = materialise(copies, "copies")
    discard(signed, firsts)
    rows = copies.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key", "n")
    shared = materialise(shared, "shared")
    # merge joins at every size: what they need grows as the input does, and a hot bucket can be split
    found_in = materialise(rows.join(shared.hint("merge"), "key"), "found")
    weight = found_in.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    members = materialise(found_in.join(weight, "node").select("key", "node", F.col("node").alias("label"), "weight"), "members")
    discard(shared, found_in)
    wanted = members.select(F.col("node").alias("row")).distinct()
    sets = materialise(shingle_sets(docs.join(wanted.hint("merge"), "row", "left_semi"), settings, "row", "text").withColumnRenamed("row", "id"), "shingles")
    links: list[DataFrame] = []
    given_up: list[DataFrame] = []
    labels: DataFrame | None = None
    centres = 1
    while not (buckets := _buckets(members, max(centres, settings.small))).isEmpty():
        each = members.join(buckets, "key")
        pairs = materialise(_pairs(each, centres, settings.small), "pairs")
        links.append(materialise(_alike(pairs.select("a", "b").distinct(), sets, settings.similarity), "links"))
        discard(labels)
        labels = components(reduce(DataFrame.unionByName, links))
        rest, linked = _rest(each, centres, settings.small), None
        if centres > 1:
            # a bucket goes on as long as its centres find links
            linked = materialise(pairs.join(links[-1], ["a", "b"]).select("key").distinct(), "linked")
            given_up.append(materialise(rest.join(linked, "key", "left_anti").select("key", "node"), "apart"))
            rest = rest.join(linked, "key", "left_semi")
        known = labels.select(F.col("v").alias("node"), "label")
        after = materialise(rest.join(known, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "weight"), "members")
        discard(members, buckets, pairs, linked)
        members = after
        centres *= 2
    if given_up:
        apart = reduce(DataFrame.unionByName, given_up).join(labels.select(F.col("v").alias("node"), "label"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        mixed = materialise(apart.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key"), "mixed")
        apart = materialise(apart.join(mixed.hint("merge"), "key"), "apart")
        if not apart.isEmpty():
            links.append(_crowd_links(apart, sets, settings.similarity))
            discard(labels)
            labels = components(reduce(DataFrame.unionByName, links))
        discard(mixed, apart, *given_up)
    discard(members, buckets, sets, *links)
    if labels is None:
        return copies.select("row", "id", "copy_of", F.col("node").alias("label"))
    classed = copies.select("row", "id", "copy_of", "node").join(labels.select(F.col("v").alias("node"), "label"), "node", "left")
    return classed.select("row", "id", "copy_of", F.coalesce("label", "node").alias("label"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of df: id, class_id (the smallest id of its class), copy_of (the smallest id with the same words)."""
    docs = materialise(df.select(F.monotonically_increasing_id().alias("row"), ref(id_col).alias("id"), ref(text_col).cast("string").alias("text")), "rows")
    classed = materialise(classes(docs, settings), "classed")
    discard(docs)
    # written, so that a class that holds a third of all rows can be split
    named = materialise(classed.groupBy("label").agg(F.min("id").alias("class_id")), "named")
    return classed.join(named, "label").select(ref("id").alias(id_col), "class_id", "copy_of")


def distinct_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df's rows and columns, of each class of near-duplicates the row with the smallest id (rows without one last)."""
    row = "_" * (1 + max(len(c) for c in df.columns)) + "row"
    whole = materialise(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    docs = whole.select(F.col(row).alias("row"), ref(id_col).alias("id"), ref(text_col).cast("string").alias("text"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"]
    chosen = materialise(classes(docs, settings).groupBy("label").agg(first.alias(row)).select(row), "chosen")
    return whole.join(chosen.hint("merge"), row, "left_semi").select(*map(ref, df.columns))
