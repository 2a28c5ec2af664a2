"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts split at the vocabulary's special strings, then into chunks of white space
and non-space runs, at which every pre-token boundary of those chunks is fixed.
Chunks not yet known are pre-tokenised; their distinct pre-tokens are held in one
ragged array of symbol ids, and each round applies, to every sequence that still
has a mergeable pair, that sequence's lowest-rank pair at all its places from the
left. The surviving symbols are the tokens.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted each; extra columns stay, those named like an added one as input_NAME. Long texts are cut at chunk bounds only, so a
count never depends on batches. A pre-token of n letters takes a round for each distinct
pair that it merges, each over what is left of it, so one very long run of letters costs
more than its share: 20,000 letters about a second, 80,000 about seven. Memory: the chunk cache is emptied at a fixed
number of entries or characters and never keeps a chunk of over ``LONG`` characters, and a batch of chunks is merged in pieces of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, kept, renames, slices, texts_of

#: Fixed value: the white space that the vocabulary's split pattern means.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Fixed value: the published pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 18
#: Characters that the cache holds, and the longest chunk that it keeps.
CACHE_CHARS, LONG = 1 << 24, 1 << 10
PIECE = 1 << 18
ADDED = ("n_bytes", "n_tokens")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merger:
    """Merge table of a byte-level BPE vocabulary, and counts by synchronous merging."""

    def __init__(self, vocabulary: str | bytes):
        """From a vocabulary file's path or its bytes."""
        spec = json.loads(Path(vocabulary).read_bytes() if isinstance(vocabulary, str) else vocabulary)
        vocab = spec["model"]["vocab"]
        self.size = np.int64(len(vocab) + 1)
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cache: dict[str, int] = {}
        self.held = 0
        self.chunks = re.compile(CHUNK)
        self.pretoken = regex.compile(PRETOKEN)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lens)
        done = lens.copy()
        none = np.int64(len(self.made))
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], none)
            start = np.flatnonzero(np.diff(seq, prepend=-1))
            best = np.minimum.reduceat(np.append(rank, none), start)
            active = best < none
            each = np.diff(np.append(start, len(sym)))
            done[seq[start]] = each
            if not active.any():
                break
            low = np.repeat(best, each)
            hit = np.append((rank == low[:-1]) & (rank < none), False)
            # In a run of overlapping hits every second one merges, from the left.
            fresh = hit & ~np.append(False, hit[:-1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run) % 2 == 0
            sym[hit] = self.made[low[hit]]
            keep = ~np.append(False, hit[:-1]) & np.repeat(active, each)
            sym, seq = sym[keep], seq[keep]
        return done

    def learn(self, chunks: set[str]) -> None:
        """Count every chunk that isn't known yet."""
        todo = list(chunks)
        split = [self.pretoken.findall(c) for c in todo]
        distinct = list({w for s in split for w in s})
        counts: dict[str, int] = {}
        a = size = 0
        raw = [w.encode() for w in distinct]
        for b in range(len(raw) + 1):
            if b == len(raw) or size + len(raw[b]) > PIECE and b > a:
                if b > a:
                    counts.update(zip(distinct[a:b], self.merged(raw[a:b]).tolist(), strict=True))
                a, size = b, 0
            if b < len(raw):
                size += len(raw[b])
        for c, s in zip(todo, split, strict=True):
            self.cache[c] = sum(map(counts.__getitem__, s))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; unknown chunks of all the texts are merged together."""
        found = [[self.chunks.findall(s) for s in (self.cut.split(t) if self.cut else [t])] for t in texts]
        todo = {c for text in found for s in text for c in s if c not in self.cache}
        if len(self.cache) + len(todo) > CACHE or self.held > CACHE_CHARS:
            self.cache.clear()
            self.held = 0
            todo = {c for text in found for s in text for c in s}
        self.learn(todo)
        known = self.cache.__getitem__
        counts = [len(text) - 1 + sum(sum(map(known, s)) for s in text) for text in found]
        for c in [c for c in todo if len(c) > LONG]:
            del self.cache[c]
        self.held += sum(n for c in todo if (n := len(c)) <= LONG)
        return counts


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_bytes and n_tokens to a table with a text column, which goes.

    The vocabulary file is read on the driver and sent to the tasks.
    """
    clash = renames(df.columns, ADDED)
    df, text = apart(df, ADDED), clash.get(text, text)
    own = [c for c in df.columns if c != text]
    file = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    schema = T.StructType([*[df.schema[c] for c in own], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = kept(Merger, file.value)
        for batch in slices(batches, text, 2 << 20):
            texts = texts_of(batch, text)
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            n_tokens = pa.array(merger.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], n_bytes, n_tokens], names=[*own, "n_bytes", "n_tokens"])

    return df.select(*own, text).mapInArrow(run, schema)
