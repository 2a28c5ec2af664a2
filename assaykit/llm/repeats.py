"""Suffix-array dedup by prefix-free parsing: removal of repeated byte strings.

Parsing: rolling hashes of ``GRAM`` bytes are taken at every place of a text. The
trigger of a window of ``length`` bytes is its least hash (leftmost among equals), so
equal windows have equal triggers, whatever surrounds them, and no window lacks one. A
phrase is a stretch of consecutive windows with one trigger: neighbouring phrases
overlap by ``length - 1`` bytes, and each window lies in exactly one phrase. The
dictionary holds each distinct phrase once, at its first place in corpus order (doc_id,
then offset); the parse is the row of phrases of each text. All windows of a phrase
that the parse holds earlier are repeats, without a look at its bytes.

Suffix array: a dictionary phrase's suffixes of at least ``length`` bytes are its
windows. A phrase whose trigger no other phrase has can share no window, so its
suffixes stand alone in the order and aren't sorted. All others go to a task by trigger,
which sorts the suffixes of its share of the dictionary, cut to ``length`` bytes, by
their bytes (Spark's sort, so they may spill). Suffixes that agree in ``length`` bytes
are neighbours in that suffix array; the parse orders them by their places in the
corpus, and all but the first are repeats. ``corpus_order`` builds the whole order of
the corpus from the suffix arrays of dictionary and parse.

Hot triggers: a count sketch of the triggers (fixed size) finds those that so many
phrases share that one task would hold too many (a stock line in ever new contexts).
Their phrases are dealt by phrase instead, and their suffixes by sampled ranges of the
order. The sketch decides cost, never results. Repeats that meet within a batch are settled before the shuffle,
so one passage that a third of all texts hold doesn't gather in a task.

Defined cases: null and empty texts have 0 bytes and lose none; texts shorter than
``length`` lose none; rows with equal doc_id and text are one document with equal
results, rows with one doc_id and other texts are ordered by a hash of the text;
a null doc_id comes first; extra columns are ignored; an empty table stays empty.
Offsets hold 49 bits, more than the 2 GB that a text can have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_sketch, cut, mix64, parts, power, slices

LENGTH, GRAM = 100, 48
SMALL_SIDE = 100_000
#: Ranges of the suffix array at most, sampled suffixes for each bound, phrases sampled for them at most.
RANGES, PER_RANGE = 4096, 32
SKETCH_BITS = 20
_FIRST = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
# A place: 49 bits of the offset, 7 of the number of windows, 7 of the trigger's place in the phrase.
_AT, _MANY = 14, 7
_BATCH_AT = np.uint64((1 << 31) - 1)
#: What is known of a row before the shuffle: nothing, that it is a repeat, that its trigger is hot.
_OPEN, _SETTLED, _HOT = 0, 1, 2
_HIT = "key long, sig long, doc long, place long, state tinyint"


def identified(docs: DataFrame) -> DataFrame:
    """doc, text, doc_id: doc is a number for each distinct document, in corpus order.

    It is the doc_id itself unless a doc_id (or null) comes twice; then the distinct
    (doc_id, hash of the text) pairs are sorted into ranges and numbered. Whether one
    comes twice takes the ids alone, no texts.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.coalesce("doc_id", F.lit(_FIRST)).alias("doc")
    if not named.groupBy(own).count().where("count > 1").limit(1).count():
        return named.select(own, "text", "doc_id")
    named = named.withColumn("hash", F.xxhash64("text"))
    pairs = named.select("doc_id", "hash").distinct().repartitionByRange(parts(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    x, y = named.alias("x"), cut(pairs.withColumn("doc", F.monotonically_increasing_id())).alias("y")
    return x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.hash") == F.col("y.hash"))).select("y.doc", "x.text", "x.doc_id")


class Window:
    """Prefix hashes of the bytes of some texts laid end to end."""

    def __init__(self, raw: list[bytes]):
        self.lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        b = np.frombuffer(b"".join(raw), np.uint8)
        self.n = len(b)
        self.bytes = b
        up, self.down = power(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def phrases(w: Window, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, offset in text, windows, trigger in phrase, trigger name, phrase name) of each phrase."""
    none = np.zeros(0, np.int64)
    if w.n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = w.n - gram + 1
    at = np.arange(grams)
    names = w.name(at, at + gram)
    span = length - gram + 1
    value = names & ~_BATCH_AT | at.astype(np.uint64)
    pad = -(-grams // span) * span
    full = np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:grams] = value
    rows = full.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    windows = w.n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _BATCH_AT).astype(np.int64)
    valid = np.zeros(windows + 1, np.int8)
    own = np.flatnonzero(w.lens >= length)
    np.add.at(valid, w.begin[own], 1)
    np.add.at(valid, w.begin[own] + w.lens[own] - length + 1, -1)
    keep = np.cumsum(valid[:windows]) > 0
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (keep[1:] != keep[:-1])]))
    # Neighbouring texts never share an anchor: an anchor lies in its windows' text.
    end = np.append(change[1:], windows)
    good = keep[change]
    start, end = change[good], end[good]
    a, many = anchor[start], end - start
    text = np.searchsorted(w.begin, start, "right") - 1
    sig = mix64(w.name(start, end + length - 1) + (many << 7 | (a - start)).astype(np.uint64) * _ODD)
    return text, start - w.begin[text], many, a - start, names[a], sig


def _distinct(*cols: np.ndarray, before: tuple | None = None) -> list[np.ndarray]:
    """Sorted rows without those that equal the row before: equal rows of the input are one document."""
    if not len(cols[0]):
        return list(cols)
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    new[0] = before is None or before != tuple(c[0] for c in cols)
    return [c[new] for c in cols]


def _settled(key: np.ndarray, sig: np.ndarray, doc: np.ndarray, place: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """A batch's rows; those that an earlier row of the batch repeats are marked and spread by a name of their own, those of hot triggers by phrase."""
    order = np.lexsort((place, doc, sig, key))
    key, sig, doc, place = _distinct(key[order], sig[order], doc[order], place[order])
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (sig[1:] == sig[:-1])
    state = np.where(again, _SETTLED, np.where(hot[key >> np.uint64(64 - SKETCH_BITS)], _HOT, _OPEN)).astype(np.int8)
    key = np.where(state == _HOT, mix64(key ^ sig * _ODD), key)
    key = np.where(again, mix64(place.view(np.uint64) ^ doc.view(np.uint64) * _ODD), key)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(doc), pa.array(place), pa.array(state)], names=["key", "sig", "doc", "place", "state"])


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def hot_triggers(docs: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Mask over the buckets of trigger names: those with more phrases than a quarter of a task's fair share, and than four times the mean."""

    def triggers(batch: pa.RecordBatch) -> np.ndarray:
        key, sig = phrases(Window(_raw(batch)), length)[4:]
        order = np.lexsort((sig, key))
        return _distinct(key[order], sig[order])[0]

    counts = count_sketch(docs.select("text"), triggers, SKETCH_BITS, 2 << 20)
    total = int(counts.sum())
    return counts > max(64, 4 * total >> SKETCH_BITS, total // (4 * parts(docs.sparkSession)))


def parsed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The parse of all texts: one row a phrase."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_triggers(docs, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in slices(batches, "text", 2 << 20):
            ids = batch.column("doc").to_numpy()
            text, at, many, trigger, key, sig = phrases(Window(_raw(batch)), length)
            if len(key):
                yield _settled(key, sig, ids[text], at << _AT | many << _MANY | trigger, hot)

    return docs.select("doc", "text").mapInArrow(run, _HIT)


def dictionary(rows: DataFrame) -> DataFrame:
    """(open, hot, key, doc, place): the parse's phrases that stand earlier, and with open the dictionary's phrases whose trigger others share."""
    dealt = rows.repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key", "sig", "doc", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last dictionary phrase so far (key, doc, place), and whether it was given out.
        held: tuple[int, int, int] | None = None
        told, last, row = True, None, None
        for batch in batches:
            key, sig, doc, place, state = (batch.column(i).to_numpy() for i in range(5))
            done = state == _SETTLED
            # Repeats need no trigger any more.
            out = [(False, np.zeros_like(key[done]), doc[done], place[done], state[done])]
            key, sig, doc, place, state = _distinct(*(x[~done] for x in (key, sig, doc, place, state)), before=row)
            if len(key):
                row = key[-1], sig[-1], doc[-1], place[-1], state[-1]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
                new[0] = last != (key[0], sig[0])
                out.append((False, np.zeros_like(key[~new]), doc[~new], place[~new], state[~new]))
                last = key[-1], sig[-1]
                k, d, p, t = key[new], doc[new], place[new], state[new]
                if len(k):
                    same = np.zeros(len(k) + 1, bool)
                    same[1:-1] = k[1:] == k[:-1]
                    same[0] = held is not None and held[0] == k[0]
                    if same[0] and not told:
                        out.append((True, *(np.array([x], np.int64) for x in held), t[:1]))
                    many = same[:-1] | same[1:] | (t == _HOT)
                    out.append((True, k[many], d[many], p[many], t[many]))
                    held, told = (k[-1], d[-1], p[-1]), bool(many[-1])
            n = [len(x[1]) for x in out]
            if sum(n):
                cols = [np.concatenate([x[i] for x in out]) for i in range(1, 5)]
                flag = np.repeat([x[0] for x in out], n)
                yield pa.RecordBatch.from_arrays([pa.array(flag), pa.array(cols[3] == _HOT), *map(pa.array, cols[:3])], names=["open", "hot", "key", "doc", "place"])

    return dealt.mapInArrow(run, "open boolean, hot boolean, key long, doc long, place long")


def spelled(docs: DataFrame, asked: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds its bytes to each dictionary phrase (hot, key, doc, place)."""
    few = asked.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    per = asked.groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("key").alias("keys"), F.collect_list("hot").alias("hots"))
    met = docs.select("doc", "text").join(F.broadcast(per) if few else per, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            lists = batch.column("places")
            places, raw = lists.flatten().to_numpy(), _raw(batch)
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, many = places >> _AT, places >> _MANY & 127
            held = [raw[t][a:z] for t, a, z in zip(text.tolist(), start.tolist(), (start + many + length - 1).tolist(), strict=True)]
            cols = [batch.column("hots").flatten(), batch.column("keys").flatten(), pa.array(held, pa.binary()), pa.array(batch.column("doc").to_numpy()[text]), pa.array(places)]
            yield pa.RecordBatch.from_arrays(cols, names=["hot", "key", "phrase", "doc", "place"])

    return met.mapInArrow(run, "hot boolean, key long, phrase binary, doc long, place long")


def suffixes(rows: DataFrame, bounds: np.ndarray | None = None, length: int = LENGTH) -> DataFrame:
    """(part, suffix, doc, place): the suffixes of phrases, cut to length bytes.

    With bounds, part is a suffix's range, and of suffixes that are equal within a batch
    only the first has bytes; the others are known repeats, with none, in part -1.
    """
    shared = None if bounds is None else rows.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(length)
        for batch in batches:
            if not batch.num_rows:
                continue
            w = Window(batch.column("phrase").to_pylist())
            doc, place, many = batch.column("doc").to_numpy(), batch.column("place").to_numpy(), w.lens - length + 1
            each = np.repeat(np.arange(len(many)), many)
            step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            start, doc, at = w.begin[each] + step, doc[each], (place >> _AT)[each] + step
            first = np.ones(len(start), bool)
            if shared:
                name = w.name(start, start + length)
                order = np.lexsort((at, doc, name))
                name, start, doc, at = name[order], start[order], doc[order], at[order]
                new = np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
                name, start, doc, at = name[new], start[new], doc[new], at[new]
                first = np.append(True, name[1:] != name[:-1])
            for a in range(0, len(start), 1 << 15):
                z = min(len(start), a + (1 << 15))
                own = np.flatnonzero(first[a:z])
                raw = w.bytes[start[a:z][own][:, None] + steps]
                part = np.full(z - a, -1, np.int32)
                part[own] = np.searchsorted(shared.value, raw.view(f"S{length}").ravel(), "right") if shared else 0
                ends = np.cumsum(np.where(first[a:z], length, 0), dtype=np.int32)
                held = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(part), held, pa.array(doc[a:z]), pa.array(at[a:z] << _AT | 1 << _MANY)], names=["part", "suffix", "doc", "place"])

    return rows.select("phrase", "doc", "place").mapInArrow(run, "part int, suffix binary, doc long, place long")


def range_bounds(rows: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Bounds of about equal ranges of the phrases' suffixes, from a hashed sample of phrases; at most RANGES - 1 of them."""
    ranges = min(RANGES, 4 * parts(rows.sparkSession))
    share = (ranges * PER_RANGE << 20) // max(rows.count(), 1) + 1
    few = rows.where(F.pmod(F.xxhash64("doc", "place"), F.lit(1 << 20)) < F.lit(share)).limit(2 * ranges * PER_RANGE)
    found = suffixes(few, None, length).where(F.shiftright("place", _AT) % 16 == 7).limit(8 * ranges * PER_RANGE).select("suffix").toArrow()
    held = np.sort(np.array(found.column(0).to_pylist() or [b""], f"S{length}"))
    return np.unique(held[np.arange(1, ranges) * len(held) // ranges])


def sorted_suffixes(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """The dictionary's suffix array: within each partition, suffixes in the order of their bytes, then of the corpus.

    Phrases go to a task by trigger and are taken apart there, so each is sent once.
    Those of hot triggers are taken apart first and sent by ranges of the order.
    """
    n, hot = parts(rows.sparkSession), rows.where("hot")
    order = ("suffix", "doc", "place")
    cold = suffixes(rows.where("not hot").repartition(n, "key"), None, length).sortWithinPartitions(*order)
    if not hot.limit(1).count():
        return cold
    spread = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("doc", "place"), F.lit(1 << 16)).cast("int")).otherwise(F.col("part"))
    ranged = suffixes(hot, range_bounds(hot, length), length).withColumn("part", spread).repartition(n, "part")
    return cold.unionByName(ranged.sortWithinPartitions(*order))


def later(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, place) of the suffixes that an equal one precedes in a suffix array, and of the known repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row = b"", None
        for batch in batches:
            done = batch.column("part").to_numpy() < 0
            doc, place = batch.column("doc").to_numpy(), batch.column("place").to_numpy()
            again = done.copy()
            if not done.all():
                held = batch.column("suffix").filter(pa.array(~done))
                at = np.frombuffer(held.buffers()[1], np.int32)[held.offset]
                raw = np.frombuffer(held.buffers()[2], np.uint8)[at : at + len(held) * length].reshape(-1, length)
                d, p = doc[~done], place[~done]
                same, own = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
                same[1:] = (raw[1:] == raw[:-1]).all(1)
                # Equal rows come from rows of one document.
                own[1:] = (d[1:] == d[:-1]) & (p[1:] == p[:-1])
                same[0], own[0] = last == raw[0].tobytes(), row == (d[0], p[0])
                last, row = raw[-1].tobytes(), (d[-1], p[-1])
                again[~done] = same & ~own
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(place[again])], names=["doc", "place"])

    return rows.mapInArrow(run, "doc long, place long")


def covered(spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, starts, ends: the covered stretches of each text, merged."""
    dealt = spans.select("doc", F.shiftrightunsigned("place", _AT).alias("at"), F.shiftrightunsigned("place", _MANY).bitwiseAND(127).alias("many"))
    dealt = dealt.repartition(parts(spans.sparkSession), "doc").sortWithinPartitions("doc", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # doc, starts, ends of the text that isn't over

        def give(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc", "starts", "ends"])

        for batch in batches:
            doc, at, many = (batch.column(i).to_numpy() for i in range(3))
            if not len(doc):
                continue
            end = at + many + length - 1
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist()
            out = []
            for a, z in zip(edge, [*edge[1:], len(doc)], strict=True):
                reach = np.maximum.accumulate(end[a:z])
                new = np.flatnonzero(np.concatenate([[True], at[a + 1 : z] > reach[:-1]]))
                starts, ends = at[a:z][new].tolist(), reach[np.append(new[1:] - 1, z - a - 1)].tolist()
                if held and held[0] == doc[a]:
                    while starts and starts[0] <= held[2][-1]:
                        held[2][-1] = max(held[2][-1], ends.pop(0))
                        starts.pop(0)
                    held[1] += starts
                    held[2] += ends
                else:
                    if held:
                        out.append(tuple(held))
                    held = [doc[a], starts, ends]
            if out:
                yield give(out)
        if held:
            yield give([tuple(held)])

    return dealt.mapInArrow(run, "doc long, starts array<long>, ends array<long>")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """Columns of REMOVED (kept only with keep_bytes): every text without its repeated bytes."""
    own = identified(docs)
    found = cut(dictionary(parsed(own, length)))
    phrase = cut(spelled(own, found.where("open").drop("open"), length))
    again = cut(later(sorted_suffixes(phrase, length), length))
    spans = cut(covered(found.where("not open").select("doc", "place").unionByName(again), length))
    joined = own.join(spans, "doc", "left").select("doc_id", "text", "starts", "ends")
    schema = REMOVED if keep_bytes else REMOVED.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for raw, starts, ends in zip(_raw(batch), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                at, pieces, gone = 0, [], 0
                for a, z in zip(starts or (), ends or (), strict=True):
                    pieces.append(raw[at:a])
                    gone += z - a
                    at = z
                rest = b"".join([*pieces, raw[at:]])
                rows.append((len(raw), gone, len(starts or ()), hashlib.sha256(rest).hexdigest(), rest))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols][: len(names)], names=names)

    return joined.mapInArrow(run, schema)


def _numbered(df: DataFrame, *cols: str) -> DataFrame:
    """Adds order: numbers that grow as the rows do by cols. Rows are sorted in ranges, so no task sees them all."""
    ranged = df.repartitionByRange(parts(df.sparkSession), *cols).sortWithinPartitions(*cols)
    return cut(ranged.withColumn("order", F.monotonically_increasing_id()))


def whole_phrases(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, nth, at, many, phrase): each text as phrases that start at places of their own and reach ``length`` bytes into the next.

    Bytes are one higher and each text ends with byte 0. No phrase, nor what is left of
    one after some of its own places, is the start of another such string: its last
    window is the first one with another trigger, and that is a matter of content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            raw, out = _raw(batch), []
            text, at, *_ = phrases(Window(raw), length)
            edges = np.searchsorted(text, np.arange(len(raw) + 1))
            for t, (doc, b) in enumerate(zip(batch.column("doc").to_pylist(), raw, strict=True)):
                starts = [0, *at[edges[t] : edges[t + 1]].tolist()[1:]]
                shown = bytes(x + 1 for x in b) + b"\0"
                for nth, (a, z) in enumerate(zip(starts, [*starts[1:], len(b)], strict=True)):
                    out.append((doc, nth, a, z - a, shown[a : z + length] if z < len(b) else shown[a:]))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["doc", "nth", "at", "many", "phrase"])

    return docs.select("doc", "text").distinct().mapInArrow(run, "doc long, nth long, at long, many long, phrase binary")


def parse_order(parse: DataFrame) -> DataFrame:
    """(doc, nth, rank): the parse's suffix array, from (doc, nth, name), names in the order of their phrases.

    Each round doubles how many phrases a rank compares; it ends when none splits any
    more. Suffixes that are equal to their texts' ends share a rank.
    """
    now, reach, kinds = parse.select("doc", "nth", F.col("name").alias("rank")), 1, -1
    while (found := now.select("rank").distinct().count()) != kinds:
        kinds = found
        then = now.select("doc", (F.col("nth") - reach).alias("nth"), F.col("rank").alias("next"))
        both = cut(now.join(then, ["doc", "nth"], "left").withColumn("next", F.coalesce("next", F.lit(-1))))
        ranks = _numbered(both.select("rank", "next").distinct(), "rank", "next")
        now, reach = cut(both.join(ranks, ["rank", "next"]).select("doc", "nth", F.col("order").alias("rank"))), 2 * reach
    return now


def corpus_order(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, at, order): every byte's suffix of every text, numbered in the order of the suffixes to their texts' ends.

    The dictionary's suffixes are sorted by their bytes once, however often their phrases
    occur; places of equal dictionary suffixes follow the rank of the parse's suffix after
    them; equal suffixes follow their places in the corpus. Rows with one doc_id and text
    count once. Its cost follows the dictionary and the number of places, so it suits
    text that repeats much; ``remove`` needs no whole order and doesn't call it.
    """
    own = identified(docs)
    held = cut(whole_phrases(own, length))
    names = _numbered(held.select("phrase").distinct(), "phrase").withColumnRenamed("order", "name")
    parse = cut(held.join(names, "phrase").select("doc", "nth", "at", "many", "name"))
    tails = held.where("many > 0").select("phrase", "many").distinct().join(names, "phrase").select("name", "phrase", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("step"))
    tails = tails.select("name", "step", F.expr("substring(phrase, cast(step as int) + 1)").alias("tail"))
    array = tails.join(_numbered(tails.select("tail").distinct(), "tail"), "tail").select("name", "step", F.col("order").alias("tail"))
    after = parse_order(parse).select("doc", (F.col("nth") - 1).alias("nth"), F.col("rank").alias("after"))
    placed = parse.join(after, ["doc", "nth"], "left").join(array, "name").select("tail", F.coalesce("after", F.lit(-1)).alias("after"), "doc", (F.col("at") + F.col("step")).alias("at"))
    ids = own.select("doc", "doc_id").distinct()
    return _numbered(placed, "tail", "after", "doc", "at").join(ids, "doc").select("doc_id", "at", "order")
