"""Phrase collocation mining: count tries of shards, merged by prefix range.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those into
words; everything is counted per language. A phrase of ``deepest`` words at most that
occurs ``least`` times is made of shorter ones that do, so passes over growing lengths find all:

1. words, counted per task and summed; a bitmap of fixed size keeps the frequent ones' names;
2. pairs of such words, by 64-bit names, into a second bitmap, and triples of such pairs into a third;
3. a count trie for each shard, of all phrases whose words, pairs and triples may be frequent:
   a level is a sorted array of (parent, word) with counts.

The bitmaps rule out, and a false yes costs a node: no frequent phrase is lost. Each
trie is cut into 2**RANGE_BITS ranges of two-word prefixes, by the prefixes' names, so that a word
that starts a third of all phrases lies in many ranges; each range is serialised as one row,
its nodes in the order of a walk. A task merges the rows of a range: equal paths add
up, rare ones go. The walk over a merged range keeps the counts of the nodes above, which are a
phrase's left parts of two words and more; single words were counted before. Right parts are
the nodes that suffix links name, each by dropping first words. Those counts also say
which phrases lie in an equally frequent longer one: if any does, then one by a single word.

Scores are exact: products are decimals of 38 digits.

Defined cases: null texts are empty; a null language is ``und``; empty pieces give nothing;
a language without candidates has no rows; repeated rows count each; an empty
table gives an empty result; extra columns are ignored; long texts are cut into shards
between pieces only where a piece ends, a piece of any length stays whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEGMENTS, cut, mix64, slices

LEAST, DEEPEST, TOP = 100, 5, 2000
#: Bits of the number of prefix ranges.
RANGE_BITS = 8
SMALL_SIDE = 100_000
_BREAKS = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_STOP = b"."
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Limits(NamedTuple):
    """Words of a shard, distinct words that a task keeps, and bits of the names that bitmaps hold (24: 2 MB each). They decide cost, never results."""

    shard: int = 2_000_000
    vocabulary: int = 500_000
    bits: int = 24


LIMITS = Limits()


class Vocabulary(dict):
    """Numbers of words in the order met; 0 is the end of a piece."""

    def __init__(self, lang: str) -> None:
        super().__init__({_STOP: 0})
        self.lang = lang
        self.named = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def names(self) -> np.ndarray:
        """64-bit names of (language, word), by number."""
        if len(self.named) < len(self):
            seed = xxhash.xxh64_intdigest(self.lang.encode())
            fresh = [xxhash.xxh64_intdigest(w, seed) for w in list(self)[len(self.named) :]]
            self.named = np.append(self.named, np.array(fresh, np.uint64))
        return self.named


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in order, with a stop wherever pieces meet."""
    return raw.lower().translate(_BREAKS).replace(b"\n", b" . ").split()


def shards(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[tuple[Vocabulary, np.ndarray]]:
    """Numbered words of some texts of one language each time, a stop after every text.

    A task holds about as many words and distinct ones as the limits say, over all languages.
    """
    held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
    n_words = 0
    for batch in slices(batches, "text", 4 << 20):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            vocabulary, arrays = held.setdefault(lang, (Vocabulary(lang), []))
            words = words_of(b" . ".join([*texts, b""]))
            arrays.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            n_words += len(words)
        full = sum(len(v) for v, _ in held.values()) >= limits.vocabulary
        if full or n_words >= limits.shard:
            for vocabulary, arrays in held.values():
                if arrays:
                    yield vocabulary, np.concatenate(arrays)
                    arrays.clear()
            n_words = 0
            if full:
                held.clear()
    for vocabulary, arrays in held.values():
        if arrays:
            yield vocabulary, np.concatenate(arrays)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")


def word_counts(texts: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """lang, word, f of all words; the word '' has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vocabulary, ids in shards(batches, limits):
            counts = np.bincount(ids, minlength=1)
            seen = np.flatnonzero(counts[1:]) + 1
            words = list(vocabulary)
            names = [b"", *[words[i] for i in seen.tolist()]]
            f = np.append(counts[1:].sum(), counts[seen])
            yield pa.RecordBatch.from_arrays([pa.array([vocabulary.lang] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "word", "f"])

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def bitmap(rows: DataFrame, names: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Flags of the top bits of all rows' names: each task sends its own in segments, which are joined by segment."""
    kind, wide = "segment int, flags binary", (1 << bits) // SEGMENTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[(names(batch) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if flags.any():
            packed = [np.packbits(x).tobytes() for x in flags.reshape(SEGMENTS, wide)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "flags"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint8)
                found[i] = found[i] | x if i in found else x
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["segment", "flags"])

    flags = np.zeros((SEGMENTS, wide // 8), np.uint8)
    out = rows.mapInArrow(mark, kind).repartition(SEGMENTS, "segment").mapInArrow(unite, kind).toArrow()
    for i, raw in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
        flags[i] = np.frombuffer(raw, np.uint8)
    return flags.reshape(-1)


def _in(flags: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names >> np.uint64(64 - 3 - int(len(flags)).bit_length() + 1)
    return (flags[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _word_names(batch: pa.RecordBatch) -> np.ndarray:
    seeds: dict[str, int] = {}
    out = []
    for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True):
        seed = seeds.get(lang) or seeds.setdefault(lang, xxhash.xxh64_intdigest(lang.encode()))
        out.append(xxhash.xxh64_intdigest(word.encode(), seed))
    return np.array(out, np.uint64)


def grams(vocabulary: Vocabulary, ids: np.ndarray, held: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a phrase of ``size`` words begins whose parts may all be frequent, and the phrases' names.

    held: bitmaps of words, pairs and so on, up to those of ``size`` - 1 words.
    """
    word = vocabulary.names()
    ok = _in(held[0], word)
    ok[0] = False
    at = np.flatnonzero(ok[ids])
    name = word[ids[at]]
    for n in range(2, size + 1):
        # A phrase goes on where the phrase that begins a word later is there too.
        on = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, name = at[on], mix64(name[on] * _ODD + word[ids[at[on] + n - 1]])
        if n < size:
            kept = _in(held[n - 1], name)
            at, name = at[kept], name[kept]
    return at, name


def gram_counts(texts: DataFrame, held: list[np.ndarray], size: int, limits: Limits = LIMITS) -> DataFrame:
    """name, f of all phrases of ``size`` words whose parts the bitmaps hold. A task sums its own up to a number of names."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def batch(names: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(f, pa.int64())], names=["name", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, f = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for vocabulary, ids in shards(batches, limits):
            fresh, n = np.unique(grams(vocabulary, ids, shared.value, size)[1], return_counts=True)
            every, place = np.unique(np.concatenate([names, fresh]), return_inverse=True)
            names, f = every, np.bincount(place, np.concatenate([f, n]), len(every)).astype(np.int64)
            if len(names) >= limits.shard:
                yield batch(names, f)
                names, f = names[:0], f[:0]
        if len(names):
            yield batch(names, f)

    return texts.mapInArrow(run, "name long, f long").groupBy("name").agg(F.sum("f").alias("f"))


def trie(ids: np.ndarray, ok: np.ndarray, follows: np.ndarray, deepest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of the count trie of a shard: (parent's place in the level above, word, count), sorted by parent and word.

    follows: for each place, of how many words a phrase may be at most that begins there and whose last
    three words, or all, may be frequent together at each of its ends: 1, 2 or 3 (and more).
    """
    at = np.flatnonzero(ok[ids])
    word, node, count = np.unique(ids[at], return_inverse=True, return_counts=True)
    levels = [(np.zeros(len(word), np.int64), word, count)]
    wide = int(ids.max(initial=0)) + 1
    for depth in range(1, deepest):
        on = at + depth < len(ids)
        # The phrase's last three words are frequent together, or both of a phrase of two.
        on[on] = follows[at[on] + max(0, depth - 2)] > min(depth, 2)
        at, node = at[on], node[on]
        key, node, count = np.unique(node * wide + ids[at + depth], return_inverse=True, return_counts=True)
        levels.append((key // wide, key % wide, count))
    return levels


def paths(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each node from the root, -1 beyond its depth; counts) of all nodes, in the order of a walk from the root."""
    deepest, rows, above = len(levels), [], np.zeros((1, 0), np.int64)
    for depth, (parent, word, _) in enumerate(levels):
        above = np.column_stack([above[parent] if depth else np.zeros((len(word), 0), np.int64), word])
        rows.append(np.column_stack([above, np.full((len(word), deepest - depth - 1), -1, np.int64)]))
    every = np.concatenate(rows)
    order = np.lexsort(every.T[::-1])
    return every[order], np.concatenate([c for _, _, c in levels])[order]


def runs(texts: DataFrame, held: list[np.ndarray], deepest: int = DEEPEST, limits: Limits = LIMITS) -> DataFrame:
    """range, lang, words, path, f: the tries of shards, a row for each range: distinct words, the nodes' numbers of them (of 32 bits, ``deepest`` a node, -1 beyond its depth) and counts (of 64)."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vocabulary, ids in shards(batches, limits):
            words, *more = shared.value
            ok = _in(words, vocabulary.names())
            ok[0] = False
            follows = ok[ids].astype(np.int8)
            for size, flags in enumerate(more, 2):
                at, names = grams(vocabulary, ids, shared.value, size)
                follows[at[_in(flags, names)]] = size
            # Numbers in byte order, so that sorted arrays are in the order of words.
            kept = sorted((w, i) for w, i in vocabulary.items() if ok[i])
            number = np.array([0, *[i for _, i in kept]], np.int64)
            rank = np.zeros(len(vocabulary), np.int64)
            rank[number[1:]] = np.arange(1, len(number))
            path, f = paths(trie(rank[ids], np.arange(len(number)) > 0, follows, deepest))
            longer = path[:, 1] >= 0
            path, f = path[longer], f[longer]
            name = vocabulary.names()[number]
            part = (mix64(name[path[:, 0]] * _ODD + name[path[:, 1]]) >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            rows = []
            for some in np.split(order, cuts) if len(order) else ():
                used, at = np.unique(path[some], return_inverse=True)
                gap = int(used[0] == -1)
                numbers = (at.reshape(len(some), deepest) - gap).astype(np.int32)
                rows.append((int(part[some[0]]), vocabulary.lang, b"\n".join(kept[u - 1][0] for u in used[gap:].tolist()), numbers.tobytes(), f[some].astype(np.int64).tobytes()))
            if rows:
                kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "lang", "words", "path", "f"])

    return texts.mapInArrow(run, "range int, lang string, words binary, path binary, f binary")


class Merge:
    """The sum of serialised tries of one range and language, held once a path."""

    def __init__(self, deepest: int) -> None:
        self.deepest, self.words = deepest, {}
        self.path, self.f = np.zeros((0, deepest), np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, words: bytes, path: bytes, f: bytes) -> None:
        number = np.array([*[self.words.setdefault(w, len(self.words)) for w in words.split(b"\n")], -1], np.int64)
        self.waiting.append((number[np.frombuffer(path, np.int32).reshape(-1, self.deepest)], np.frombuffer(f, np.int64)))
        if sum(len(x) for _, x in self.waiting) > max(1 << 18, len(self.f)):
            self.settle()

    def settle(self) -> None:
        path = np.concatenate([self.path, *[p for p, _ in self.waiting]])
        f = np.concatenate([self.f, *[x for _, x in self.waiting]])
        order = np.lexsort(path.T[::-1])
        path = path[order]
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]).any(1)
        start = np.flatnonzero(new)
        self.path, self.f, self.waiting = path[start], np.add.reduceat(f[order], start) if len(start) else f, []

    def walk(self, least: int) -> Iterator[tuple[list[bytes], int, list[int]]]:
        """(words, count, counts of the first two, three, .. words) of the nodes that occur often enough. What stands above such a node does too, and comes before it."""
        self.settle()
        spelled, above = list(self.words), [0] * self.deepest
        often = self.f >= least
        for row, f in zip(self.path[often].tolist(), self.f[often].tolist(), strict=True):
            depth = sum(x >= 0 for x in row)
            above[depth - 1] = f
            yield [spelled[x] for x in row[:depth]], f, above[1 : depth - 1]


def merged(found: DataFrame, least: int = LEAST, deepest: int = DEEPEST) -> DataFrame:
    """lang, phrase, depth, f, lefts (counts of the phrase's first 2, 3, .. words) of all phrases of two words and more that occur often enough."""
    names, kinds = ["lang", "phrase", "depth", "f", "lefts"], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def batches_of(lang: str, merge: Merge) -> Iterator[pa.RecordBatch]:
        rows = [(lang, b" ".join(words).decode(), len(words), f, lefts) for words, f, lefts in merge.walk(least)]
        for a in range(0, len(rows), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + (1 << 14)], strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, merge = None, None
        for batch in batches:
            for part, lang, words, path, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lang) != key:
                    if merge:
                        yield from batches_of(key[1], merge)
                    key, merge = (part, lang), Merge(deepest)
                merge.add(words, path, f)
        if merge:
            yield from batches_of(key[1], merge)

    dealt = found.repartition("range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(run, "lang string, phrase string, depth int, f long, lefts array<long>")


def phrases(docs: DataFrame, least: int = LEAST, deepest: int = DEEPEST, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(the nodes of ``merged`` and single words of a table of texts; lang, n: words of each language)."""
    texts = _texts(docs)
    counts = cut(word_counts(texts, limits).where(f"f >= {least} or word = ''"))
    held = [bitmap(counts.where("word != ''"), _word_names, limits.bits)]
    for size in (2, 3):
        held.append(bitmap(gram_counts(texts, held, size, limits).where(f"f >= {least}"), lambda batch: batch.column("name").to_numpy().view(np.uint64), limits.bits))
    nodes = merged(cut(runs(texts, held, deepest, limits)), least, deepest)
    single = counts.where("word != ''").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("depth"), "f", F.array().cast("array<bigint>").alias("lefts"))
    return cut(nodes.unionByName(single)), counts.where("word = ''").select("lang", F.col("f").alias("n"))


def mine(docs: DataFrame, least: int = LEAST, deepest: int = DEEPEST, top: int = TOP, limits: Limits = LIMITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``deepest`` words.

    Right parts are joined by suffix links, a row for each cut; the lowest-scoring cut counts.
    """
    nodes, sizes = phrases(docs, least, deepest, limits)
    many = sizes.limit(SMALL_SIDE + 1).count() > SMALL_SIDE
    links = F.posexplode(F.expr("transform(sequence(1, depth - 1), k -> substring_index(phrase, ' ', k - depth))")).alias("at", "link")
    heads = nodes.where("depth = 1").select("lang", F.col("phrase").alias("head"), F.col("f").alias("first"))
    longer = nodes.where("depth > 1").withColumn("head", F.substring_index("phrase", " ", 1)).join(heads, ["lang", "head"])
    cuts = longer.select("lang", "phrase", "depth", F.col("f").alias("a"), F.concat(F.array("first"), "lefts").alias("lefts"), links)
    ends = nodes.select("lang", F.col("phrase").alias("link"), F.col("f").alias("r"))
    met = cuts.join(ends, ["lang", "link"]).join(sizes if many else F.broadcast(sizes), "lang").withColumn("l", F.expr("lefts[at]"))
    wide = [F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")]
    score = F.expr("(cast(1000 * wa as decimal(20,0)) * wn) div (wl * wr)")
    met = cut(met.withColumns(dict(zip(("wa", "wn", "wl", "wr"), wide, strict=True))).withColumn("score", score.cast("long")).select("lang", "phrase", "depth", "link", "at", "a", "l", "r", "n", "score"))
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    # A phrase lies in a longer one of its own count if it does in one that is longer by its last or first word.
    longer = met.where("depth > 2")
    inside = longer.where("at = depth - 2 and l = a").select("lang", F.expr("substring_index(phrase, ' ', depth - 1)").alias("phrase")).union(longer.where("at = 0 and r = a").select("lang", "link"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.join(inside.distinct(), ["lang", "phrase"], "left_anti").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
