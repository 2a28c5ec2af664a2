"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text becomes marked words: marks (U+2581) followed by other characters; no piece
of the vocabulary crosses a word's start, nor holds certain single characters such
as line breaks, so words encode on their own. A batch's
distinct words are sorted, which walks their trie depth-first: each word starts
from the forward states of the prefix that it shares with the word before.

The forward state of a prefix depends on the model file. For unigram models it is
the Viterbi score and the last piece of the best segmentation. For pair-merge
models, where segmentations are not ranked by score sums, it is the one last piece
whose merge result is stable after the prefix before it: a row of pieces is the
merge result exactly if each neighbouring pair, merged on its own, stays that pair.
Characters that the vocabulary lacks become their bytes' pieces, or the unknown piece.

Defined cases: null and empty texts have no pieces and decode to the empty text;
repeated rows are encoded each; extra columns stay, those named like an added one as input_NAME; a literal U+2581 decodes as a
space, as in the library. Words longer than ``LONG`` characters are encoded without
being cached. Memory: the caches have fixed numbers of entries, the word cache two halves by age.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, kept, renames, slices, texts_of

MARK = "▁"
CACHE, PAIRS, LONG = 1 << 17, 1 << 18, 200
#: Stand-ins for piece ids: a string that only ends pieces, and the start of a word. Other characters count down from -1.
_ENDS, _START = 1 << 30, 1 << 21


class Encoder:
    """Pieces of a model file, and the forward pass over sorted words."""

    def __init__(self, model: str | bytes):
        """From a model file's path or its bytes."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(**({"model_file": model} if isinstance(model, str) else {"model_proto": model}))
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(own.serialized_model_proto())
        self.unigram = spec.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM
        norm = spec.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        self.unknown = 0
        texts: list[bytes] = []
        self.fallback = spec.trainer_spec.byte_fallback
        for i, p in enumerate(spec.pieces):
            text = p.piece.replace(MARK, " ").encode()
            if p.type in (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED):
                self.id[p.piece], self.score[p.piece] = i, p.score
            elif p.type == pb.ModelProto.SentencePiece.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == pb.ModelProto.SentencePiece.UNKNOWN:
                self.unknown, text = i, " ⁇ ".encode()
            else:
                text = b""
            texts.append(text)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses words")
        self.piece_bytes = texts
        self.prepare()

    def prepare(self) -> None:
        """Tables that the forward pass needs, from the pieces' ids and scores."""
        self.name = {i: p for p, i in self.id.items()} | {_START: ""}
        # Every ending of every piece: a candidate grows to the left only while it can still become a piece.
        self.tail = {p[k:]: _ENDS for p in self.id for k in range(1, len(p))} | self.id
        self.value = {i: self.score[p] for p, i in self.id.items()}
        self.least = min(self.score.values()) - 10
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stable: dict[int, bool] = {}
        # ASCII characters that stand in no longer piece never merge: words end there as well.
        joined = {c for p in self.id if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        self.word = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))

    def merged(self, s: str) -> list[str]:
        """Pair merging from single characters: best score first, leftmost among equals."""
        parts = list(s)
        while True:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def string(self, i: int) -> str:
        return self.name[i] if i >= 0 else chr(-1 - i)

    def holds(self, left: int, right: int) -> bool:
        """Whether merging two neighbouring pieces' characters gives back these two."""
        a, b = self.string(left), self.string(right)
        if len(self.stable) >= PAIRS:
            self.stable.clear()
        known = self.stable[left << 22 | right + (1 << 21)] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def forward(self, word: str, states: list) -> None:
        """Extend the states of a prefix over the rest of a word. A state is (last piece's start, its id, score)."""
        tail, stable = self.tail, self.stable
        for end in range(len(states), len(word) + 1):
            best = None
            for start in range(end - 1, -1, -1):
                i = tail.get(word[start:end], None)
                if i is None or i == _ENDS:
                    if start == end - 1:
                        char = -1 - ord(word[start])
                        if self.unigram:
                            best = (start, char, states[start][2] + self.least)
                        elif self.holds(states[start][1], char):
                            best = (start, char, 0.0)
                            break
                    if i is None:
                        break
                elif self.unigram:
                    total = states[start][2] + self.value[i]
                    if best is None or total > best[2]:
                        best = (start, i, total)
                else:
                    left = states[start][1]
                    known = stable.get(left << 22 | i + (1 << 21))
                    if known or known is None and self.holds(left, i):
                        best = (start, i, 0.0)
                        break
            states.append(best)

    def segments(self, states: list) -> list[int]:
        """Piece ids, and negative numbers for characters that are no pieces."""
        out, end = [], len(states) - 1
        while end:
            end, i, _ = states[end]
            out.append(i)
        out.reverse()
        return out

    def ids(self, found: list[int]) -> list[int]:
        if not found or min(found) >= 0:
            return found
        out: list[int] = []
        for i in found:
            if i >= 0:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in chr(-1 - i).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, words: set[str]) -> None:
        states: list = [(0, _START, 0.0)]
        before = ""
        for w in sorted(words):
            n = min(len(before), len(w))
            while before[:n] != w[:n]:
                n -= 1
            del states[n + 1 :]
            self.forward(w, states)
            self.words[w] = array("i", self.ids(self.segments(states))).tobytes()
            before = w

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; unknown words of all the texts go through one forward pass."""
        mark = MARK if self.prefix else ""
        split = [self.word.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > CACHE:
            # Words that come again move back from the older half; the others go with the next turn.
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        todo = set()
        for w in {w for s in split for w in s}:
            if w not in words:
                if (ids := older.get(w)) is not None:
                    words[w] = ids
                else:
                    todo.add(w)
        self.learn(todo)
        known = self.words.__getitem__
        out = [np.frombuffer(b"".join(map(known, s)), np.int32) for s in split]
        for w in [w for w in todo if len(w) > LONG]:
            del self.words[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: the dummy mark goes, bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


ADDED = "n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean, piece_ids array<int>"


def encode(df: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds n_pieces, pieces_sha256 (of little-endian 32-bit ids), decoded_sha256, round_trip, and with keep_ids piece_ids; the text goes.

    The model file is read on the driver and sent to the tasks.
    """
    added = T.StructType(T._parse_datatype_string(ADDED).fields[: None if keep_ids else -1])
    clash = renames(df.columns, added.names)
    df, text = apart(df, added.names), clash.get(text, text)
    own = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in own], *added])
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
    model = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(Encoder, model.value)
        for batch in slices(batches, text, 2 << 20):
            texts = texts_of(batch, text)
            cols: list[list] = [[] for _ in added]
            for t, ids in zip(texts, encoder.encode(texts), strict=True):
                back = encoder.decode(ids)
                row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t, ids)
                for c, v in zip(cols, row, strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *[pa.array(c, k) for c, k in zip(cols, types, strict=False)]], names=[*own, *added.names])

    return df.select(*own, text).mapInArrow(run, schema)
