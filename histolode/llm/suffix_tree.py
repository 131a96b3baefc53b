"""A probabilistic suffix tree over words, grown level by level from distributed counts.

A state is a context of one word or more (the end of the previous text counts as one);
the tree grows by a word a level until no context of a level passes (a caller may ask for
more than ``last_level_gain`` nats a training token of the last level).  Counting runs in chunks of a few million tokens: each chunk sends its
distinct grams with training counts to merge tasks and gets back global counts, so
traffic is bounded by the distinct grams of the chunks and no gram, however frequent,
meets in one task more than once per chunk.

* Level 0 counts words.  Level d counts the next symbols of contexts of d words, and
  only of contexts seen at least ``min_count`` times whose suffix is in the tree.
* A state's next-symbol distribution is smoothed by its suffix state's:
  p(x|s) = (n(s,x) + k p(x|suffix(s))) / (n(s) + k), from
  (c(x) + 0.1) / (N + 0.1 (V + 1)) at the root, so every distribution sums to one.
* Divergence test: over the training symbols that follow s, the mean log ratio of the
  left-one-out p(x|s) to p(x|suffix(s)) must reach ``min_gain``, with the best k of
  ``STRENGTHS``.  Leaving the symbol itself out keeps chance contexts away.
* A symbol is scored in its longest suffix state.

All grams of a state are merged in one task, except for states with over 1/P of all
tokens (at most P of them for P tasks): their grams are spread by symbol and their
gains summed, and that table of at most P rows is all that reaches the driver.

Cases: null text is empty and is its end symbol alone; rows without id are training
rows; repeated rows are counted and scored each; of strengths that tie the smallest is
taken; a very long text is a chunk of its own; without training rows every probability
is that of the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, mapped, mix, pack, parts_for, ship, steps, texts_of, unpack, unzipped, zipped

#: Pseudo-counts k among which each state chooses; the reply codes are their places from 1.
STRENGTHS = np.array([0.25, 0.5, 1, 2, 5, 20, 100, 500])
CHUNK_TOKENS = 1_500_000
#: From this level on walks are saved; before, they are larger than texts and replies, and walked again.
SAVED_FROM = 3
_CHUNK = "chunk long, doc_ids binary, has_id binary, train binary, lens binary, ids binary, part_sizes binary, words binary, n_train binary"
_REPLY = "chunk long, part int, level int, ids binary, counts binary, n long, v long, state long, gains array<double>"
_SAVED = "chunk long, walk binary"
_REQUEST = "chunk long, part int, grams binary, n long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Index(dict):
    """Numbers keys from ``start`` on in the order of their first look-up."""

    start = 0

    def __missing__(self, key) -> int:
        self[key] = n = len(self) + self.start
        return n


class Words(Index):
    start = 1  # 0 is the end symbol


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in schema.split(", ")]
    n = max(map(len, columns.values()), default=0)
    return pa.table({name: pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields})


def chunks(docs: DataFrame, n_parts: int) -> DataFrame:
    """Tokenised chunks of (doc_id, text, train); a chunk numbers its words from 1 in order of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, words, flat, rows = 0, Words(), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(words)
            part = np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % np.uint32(n_parts)
            order = np.argsort(part, kind="stable")
            renumbered = np.zeros(len(found) + 1, np.uint32)
            renumbered[order + 1] = np.arange(1, len(found) + 1, dtype=np.uint32)
            ids, train = renumbered[np.concatenate(flat)], np.array([r[1] for r in rows], bool)
            lens = np.fromiter(map(len, flat), np.int32, len(flat))
            n_train = np.bincount(ids[np.repeat(train, lens)], minlength=len(words) + 1).astype(np.uint32)
            row = {
                "chunk": [(TaskContext.get().partitionId() << 24) + made], "doc_ids": [pack(np.array([r[0] or 0 for r in rows], np.int64))], "has_id": [pack(np.array([r[0] is not None for r in rows], np.uint8))],
                "train": [pack(train.astype(np.uint8))], "lens": [pack(lens)], "ids": [pack(ids)], "part_sizes": [pack(np.bincount(part, minlength=n_parts).astype(np.uint32))], "words": [zipped(b" ".join([found[i] for i in order]))], "n_train": [pack(n_train)],
            }
            yield from _table(row, _CHUNK).to_batches()

        held = 0
        for step in steps(batches, "text"):
            for doc, train, text in zip(step.column("doc_id").to_pylist(), step.column("train").to_pylist(), texts_of(step.column("text")), strict=True):
                found = text.lower().split()
                ids = np.zeros(len(found) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
                flat.append(ids), rows.append((doc, train))
                held += len(ids)
                if held >= CHUNK_TOKENS:
                    yield from flush()
                    made, words, flat, rows, held = made + 1, Words(), [], [], 0
        if rows:
            yield from flush()

    return mapped(docs, run, _CHUNK)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places by part, in order; 16-bit keys are sorted by radix."""
    part = part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else []
    for at in np.split(order, edges[1:] if len(edges) else []):
        if len(at):
            yield int(part[at[0]]), at


def _words(blob: bytes) -> list[bytes]:
    return unzipped(blob).split()


def count_words(made: DataFrame, n_parts: int) -> DataFrame:
    """Level 0: per chunk and part the global ids and training counts of the chunk's words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, n_train, sizes in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "n_train", "part_sizes")), strict=True):
                words, n, begin = _words(blob), unpack(n_train)[1:], 0
                for part, size in enumerate(unpack(sizes).tolist()):
                    end = begin + size
                    if size:
                        yield from pa.table({"chunk": pa.array([chunk]), "part": pa.array([part], pa.int32()), "words": [zipped(b" ".join(words[begin:end]))], "n_train": [pack(n[begin:end])]}).to_batches()
                    begin = end

    def merge(table: pa.Table) -> pa.Table:
        part, index, seen, counts = table.column("part")[0].as_py(), Index(), [], []
        for blob, n in zip(table.column("words").to_pylist(), table.column("n_train").to_pylist(), strict=True):
            words = _words(blob)
            seen.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            counts.append(unpack(n))
        totals = np.bincount(np.concatenate(seen), np.concatenate(counts), len(index)).astype(np.uint64)
        ids = np.empty(len(index), np.uint64)
        ids[np.argsort(-totals.astype(np.int64), kind="stable")] = np.arange(len(index), dtype=np.uint64) * np.uint64(n_parts) + np.uint64(part + 1)
        chunk = table.column("chunk").to_pylist()
        return _table({
            "chunk": [*chunk, -1], "part": [part] * (len(chunk) + 1), "level": [0] * (len(chunk) + 1), "ids": [*(pack(_short(ids[s])) for s in seen), None], "counts": [*(pack(_short(totals[s])) for s in seen), None],
            "n": [*[None] * len(chunk), int(totals.sum())], "v": [*[None] * len(chunk), int((totals > 0).sum())],
        }, _REPLY)

    asked = mapped(made.select("chunk", "words", "n_train", "part_sizes"), ask, "chunk long, part int, words binary, n_train binary")
    return grouped(asked, ["part"], merge, _REPLY)


def _short(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not len(values) or values.max() < 1 << 32 else values.astype(np.uint64)


_SEED = np.uint64(0x2545F4914F6CDD1D)


def _more_hash(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The hash of a gram with one more symbol."""
    return mix(h + ids.astype(np.uint64))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), _SEED)
    for c in columns:
        h = _more_hash(h, c)
    return h


class Model:
    """What all tasks know: corpus totals and settings (a fixed size, but for at most P hot states)."""

    def __init__(self, n_tokens: int, n_words: int, n_docs: int, n_parts: int, min_count: int, min_gain: float) -> None:
        self.n_tokens, self.n_words, self.n_docs, self.n_parts = n_tokens, n_words, n_docs, n_parts
        self.min_count, self.min_gain = min_count, min_gain
        self.hot_from = max(n_tokens // n_parts, 20_000)
        self.hot: dict[int, int] = {}

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1))


class Walk:
    """A chunk at one level: the grams of tokens whose suffix state is in the tree, and what the others summed to.

    A gram is known by its state (the gram of the level below, one token back) and its
    last symbol; hashes grow with it, and global ids of symbols are looked up for them.
    ``save`` has all that the next level needs, so deep levels are not walked again.
    """

    #: Saved arrays: of texts, of words, of tokens, of states and of grams.
    FIELDS = ("doc_ids", "has_id", "train", "lens", "known", "base", "done", "gid", "steps", "place", "state_hash", "state_count", "state_sizes", "symbol", "parent")

    def __init__(self, model: Model, level: int) -> None:
        self.model, self.level = model, level

    @classmethod
    def begin(cls, model: Model, chunk: dict, replies: list[dict]) -> Walk:
        self = cls(model, 0)
        self.doc_ids, self.has_id, self.train, self.lens = (unpack(chunk[c]) for c in ("doc_ids", "has_id", "train", "lens"))
        tokens, answers = unpack(chunk["ids"]).astype(np.int32), {r["part"]: r for r in replies}
        known = [answers[k] for k in np.flatnonzero(unpack(chunk["part_sizes"])).tolist()]
        self.gid = np.concatenate([np.zeros(1, np.uint64), *(unpack(r["ids"]).astype(np.uint64) for r in known)])
        count = np.concatenate([np.array([model.n_docs]), *(unpack(r["counts"]).astype(np.int64) for r in known)])
        self._texts()
        root = model.root(count.astype(float))
        self.known = np.add.reduceat((count > 0).astype(np.int64)[tokens], self.starts)
        self.base, self.done = np.add.reduceat(np.log10(root)[tokens], self.starts), np.zeros(len(self.lens))
        self.at, self.place, self.symbol = np.arange(len(tokens), dtype=np.int32), tokens, np.arange(len(self.gid), dtype=np.int32)
        self.inside, self.count, self.hash, self.value = np.ones(len(tokens), bool), count, _more_hash(np.full(len(self.gid), _SEED), self.gid), root
        return self

    @classmethod
    def resume(cls, model: Model, level: int, saved: bytes) -> Walk:
        """What ``save`` made of a level."""
        self = cls(model, level)
        for name, values in zip(cls.FIELDS, _apart(saved), strict=True):
            setattr(self, name, values)
        self._texts(), self._grams()
        self.at = np.cumsum(self.steps, dtype=np.int32)
        return self

    def answer(self, replies: list[dict]) -> None:
        """The merge tasks' replies to this level's requests."""
        values, answers = np.zeros(len(self.symbol), np.int64), {r["part"]: r for r in replies}
        for part, at in _split(self.part):
            values[at] = unpack(answers[part]["counts"])
        self.count, code = values >> 4, values & 15
        hot, spread = self.state_count > self.model.hot_from, np.zeros(len(self.state_hash), np.int64)
        for i in np.flatnonzero(hot):
            spread[i] = self.model.hot.get(int(self.state_hash[i].view(np.int64)), 0)
        code = np.where(hot[self.state], spread[self.state], code)
        strength = STRENGTHS[np.maximum(code, 1) - 1]
        self.value = (self.count + strength * self.parent) / (self.state_count[self.state] + strength)
        self.inside = (code > 0)[self.place]
        self._leave(self.at[~self.inside], self.place[~self.inside], self.parent)

    def _texts(self) -> None:
        self.lens = self.lens.astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.text = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)

    def _grams(self) -> None:
        """What follows from the states and symbols of the grams."""
        self.state = np.repeat(np.arange(len(self.state_hash), dtype=np.int32), self.state_sizes)
        state_hash = self.state_hash[self.state]
        self.hash = _more_hash(state_hash, self.gid[self.symbol])
        hot = (self.state_count > self.model.hot_from)[self.state]
        self.part = (np.where(hot, self.hash, state_hash) % np.uint64(self.model.n_parts)).astype(np.int64)

    def _leave(self, at: np.ndarray, place: np.ndarray, p: np.ndarray) -> None:
        """Adds tokens, scored by their grams' p, to their texts' sums; no longer state of theirs is in the tree."""
        self.done = self.done + np.bincount(self.text[at], np.log10(p)[place], len(self.lens))

    def extend(self) -> None:
        """The distinct grams of the next level, whose states are this level's grams one token back."""
        self.level += 1
        gram = np.full(len(self.text), -1, np.int32)  # -1: no gram
        gram[self.at] = self.place
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        before[self.starts] = 0 if self.level == 1 else -1
        enough = np.append(self.count >= self.model.min_count, False)
        at, place = self.at[self.inside], self.place[self.inside]
        use = enough[before[at]]
        self._leave(at[~use], place[~use], self.value)
        self.at, place = at[use], place[use]
        state, self.symbol, found = _distinct(before[self.at], self.symbol[place])
        self.parent = np.zeros(len(state))
        self.parent[found] = self.value[place]
        self.place = found
        first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]]) if len(state) else np.zeros(0, np.int64)
        self.state_sizes = np.diff(first, append=len(state)).astype(np.int32)
        self.state_hash, self.state_count = self.hash[state[first]], self.count[state[first]]
        self._grams()

    def save(self) -> bytes:
        self.steps = np.diff(self.at, prepend=np.int32(0))
        return _together([getattr(self, name) for name in self.FIELDS])

    def requests(self, chunk: int) -> pa.Table:
        """A row for each merge task."""
        rows: dict[str, list] = {n.split()[0]: [] for n in _REQUEST.split(", ")}
        train = self.train.astype(bool)[self.text[self.at]]
        n_train = np.bincount(self.place[train], minlength=len(self.symbol)).astype(np.uint32)
        n_state, p = self.state_count.astype(np.uint64), self.parent.astype(np.float32)
        for part, at in _split(self.part):
            state = self.state[at]
            first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
            sizes, states = np.diff(first, append=len(state)).astype(np.uint32), state[first]
            grams = _together([self.state_hash[states], _short(n_state[states]), sizes, _short(self.gid[self.symbol[at]]), n_train[at], p[at]])
            for name, value in zip(rows, (chunk, part, grams, len(at)), strict=True):
                rows[name].append(value)
        return _table(rows, _REQUEST)

    def scores(self) -> pa.Table:
        self._leave(self.at[self.inside], self.place[self.inside], self.value)
        return pa.table({
            "doc_id": pa.array(self.doc_ids, pa.int64(), mask=~self.has_id.astype(bool)), "held_out": pa.array(~self.train.astype(bool)), "n_tokens": pa.array(self.lens), "n_known": pa.array(self.known),
            "base_score": pa.array(self.base), "score": pa.array(self.done),
        })


def _distinct(state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and each row's place among them."""
    bits = [int(x.max(initial=0)).bit_length() for x in (state, symbol)]
    low = len(state).bit_length()
    if sum(bits) + low > 63:
        distinct, found = np.unique((state.astype(np.int64) << 32) | symbol, return_inverse=True)
        return distinct >> 32, (distinct & 0xFFFFFFFF).astype(np.int32), found.astype(np.int32)
    # rows' numbers below their keys: sorting values is several times faster than sorting their places
    keys = np.sort((((state.astype(np.int64) << bits[1]) | symbol) << low) | np.arange(len(state)))
    rows, keys = keys & ((1 << low) - 1), keys >> low
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    found = np.empty(len(keys), np.int32)
    found[rows] = np.cumsum(new, dtype=np.int32) - 1
    distinct = keys[new]
    return distinct >> bits[1], (distinct & ((1 << bits[1]) - 1)).astype(np.int32), found


def _together(arrays: list[np.ndarray]) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in map(pack, arrays))


def _apart(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(unpack(blob[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal keys together, the starts of runs in it, and each key's run."""
    # places stand in the keys' lowest bits: sorting values is faster than sorting their places
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    high = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (high & low).astype(np.int64)
    high &= ~low
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    alike = high[1:][new[1:] & (high[1:] == high[:-1])]  # keys that differ in their lowest bits only
    for key in np.unique(alike):
        begin, end = np.searchsorted(high, key), np.searchsorted(high, key, "right")
        order[begin:end] = order[begin:end][np.argsort(ordered[begin:end], kind="stable")]
    if len(alike):
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
    run = np.empty(len(keys), np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def _gains(state: np.ndarray, count: np.ndarray, p: np.ndarray, n_state: np.ndarray) -> np.ndarray:
    """Per state and strength what the left-one-out p(x|s) gains over its suffix's, in nats.

    Of a gram seen once k/(n(s) - 1 + k) is left, whatever its p, so such grams are only counted.
    """
    size = len(n_state)
    once, others = np.bincount(state[count == 1], minlength=size), np.maximum(n_state, 1) - 1
    more = count > 1
    at, c, q = state[more], count[more], p[more].astype(float)
    beside, gains = others[at], np.empty((size, len(STRENGTHS)))
    for i, k in enumerate(STRENGTHS):
        gains[:, i] = once * np.log(k / (others + k)) + np.bincount(at, np.log((c - 1 + k * q) / ((beside + k) * q)) * c, size)
    return gains


def _merge(model: Model, level: int):
    def run(table: pa.Table) -> pa.Table:
        part, chunk = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        sizes = table.column("n").to_pylist()
        hashes, states, repeats, symbols, n, p = (np.concatenate(c) for c in zip(*map(_apart, table.column("grams").to_pylist()), strict=True))
        order, starts, numbers = _runs(hashes)
        known = order[starts]
        n_state, state_hash, state = states[known].astype(float), hashes[known].view(np.int64), np.repeat(numbers, repeats)
        order, starts, gram = _runs(_more_hash(np.repeat(hashes, repeats), symbols))
        count = np.add.reduceat(n[order].astype(np.int64), starts)
        head = order[starts]
        del hashes, states, repeats, symbols, n, order, starts, numbers
        state = state[head]  # grams without training count belong to states too
        gains = _gains(state, count, p[head], n_state)
        best, top = gains.argmax(axis=1), gains.max(axis=1)
        seen, hot = np.bincount(state[count > 0], minlength=len(n_state)) > 0, n_state > model.hot_from
        kept = seen & ~hot & (top >= model.min_gain * n_state)
        hot_rows = [(int(state_hash[i]), int(n_state[i]), gains[i].tolist()) for i in np.flatnonzero(seen & hot)]
        gained = float(top[kept].sum())
        code = np.where(kept, best + 1, 0)[state]
        values = ((count << 4) | code)[gram]
        cut = np.split(values, np.cumsum(sizes)[:-1])
        m = len(hot_rows) + 1  # the last row has what the states that pass gain
        return _table({
            "chunk": [*chunk, *[-1] * m], "part": [part] * (len(chunk) + m), "level": [level] * (len(chunk) + m), "counts": [*(pack(_short(x.astype(np.uint64))) for x in cut), *[None] * m],
            "n": [*[None] * len(chunk), *(r[1] for r in hot_rows), None], "state": [*[None] * len(chunk), *(r[0] for r in hot_rows), None], "gains": [*[None] * len(chunk), *(r[2] for r in hot_rows), [gained]],
        }, _REPLY)

    return run


def _walked(walks: DataFrame, replies: DataFrame, function, schema: str) -> DataFrame:
    ship(walks.sparkSession)
    answers = replies.where("chunk >= 0").select("chunk", "part", "level", "ids", "counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left.slice(0, 1).to_pylist()[0], right.to_pylist())

    return walks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _answered(model: Model, level: int):
    """The walk of a chunk through a level and its replies."""

    def run(row: dict, replies: list[dict]) -> Walk:
        if "walk" in row:
            walk = Walk.resume(model, level, row["walk"])
            walk.answer(replies)
            return walk
        by_level = [[r for r in replies if r["level"] == n] for n in range(level + 1)]
        walk = Walk.begin(model, row, by_level[0])
        for found in by_level[1:]:
            walk.extend()
            walk.answer(found)
        return walk

    return run


def _extended(model: Model, level: int, function):
    """A function of a chunk's number and its walk one level further."""

    def run(row: dict, replies: list[dict]) -> pa.Table:
        walk = _answered(model, level)(row, replies)
        walk.extend()
        return function(row["chunk"], walk)

    return run


def _ask(model: Model, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from Walk.resume(model, level, row["walk"]).requests(row["chunk"]).to_batches()

    return run


def score_texts(docs: DataFrame, max_depth: int | None = None, min_count: int = 2, min_gain: float = 0.02, last_level_gain: float = 0.0) -> DataFrame:
    """Scores of every row of docs (doc_id, text, train), learnt from rows with train.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: logarithms to base 10.
    """
    spark = docs.sparkSession
    scratch, n_parts = Scratch(spark, "suffix_tree"), parts_for(docs)
    made = scratch.keep(chunks(docs.select(F.col("doc_id").cast("long"), "text", "train"), n_parts), "chunks")
    replies = scratch.keep(count_words(made, n_parts), "level0")
    made = scratch.keep(made.drop("words", "n_train"), "texts")  # words are known from here on by their parts' answers
    scratch.drop("chunks")
    n_docs = docs.where("train").count()
    words, distinct = replies.where("chunk < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    model = Model(words + n_docs, distinct + (n_docs > 0), n_docs, n_parts, min_count, min_gain)
    depth, walks, read = 0, made, ["texts", "level0"]
    while max_depth is None or depth < max_depth:
        level = depth + 1
        if level < SAVED_FROM:
            asked = _walked(walks, replies, _extended(model, depth, lambda chunk, walk: walk.requests(chunk)), _REQUEST)
        else:
            walks = scratch.keep(_walked(walks, replies, _extended(model, depth, lambda chunk, walk: _table({"chunk": [chunk], "walk": [walk.save()]}, _SAVED)), _SAVED), f"walk{level}")
            scratch.drop(*read)  # a saved walk has all that the next level needs
            asked, read = mapped(walks, _ask(model, level), _REQUEST), [f"walk{level}"]
        reply = scratch.keep(grouped(asked, ["part"], _merge(model, level), _REPLY), f"level{level}")
        read.append(f"level{level}")
        sums = [F.sum(F.element_at("gains", k + 1)).alias(f"g{k}") for k in range(len(STRENGTHS))]
        hot = reply.where("state is not null").groupBy("state").agg(F.max("n"), *sums).collect()  # at most n_parts states
        gained = reply.where("chunk < 0 and state is null").agg(F.coalesce(F.sum(F.element_at("gains", 1)), F.lit(0.0))).first()[0]
        for row in hot:
            gains = np.array(row[2:])
            if gains.max() >= min_gain * row[1]:
                model.hot[row[0]] = int(gains.argmax()) + 1
                gained += gains.max()
        replies, depth = replies.unionByName(reply) if level < SAVED_FROM else reply, level
        if gained <= last_level_gain * model.n_tokens:
            break
    scores = _walked(walks, replies, lambda row, found: _answered(model, depth)(row, found).scores(), _SCORES)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
