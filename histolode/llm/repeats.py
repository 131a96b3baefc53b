"""Repeated byte strings over the corpus, by enhanced suffix arrays of sampled suffixes.

Every window of ``min_len`` bytes is assigned to one *anchor* inside it: the start of
its k-gram with the smallest hash (leftmost of equals).  Equal windows have equal
anchors at equal offsets, so repeats only have to be looked for among the suffixes
that start at anchors, about one byte in 35, and among those only at anchors whose
k-gram occurs twice at least.

1. Texts are cut into chunks of a few MB; each chunk asks merge tasks which of its
   anchor hashes occur more than once.
2. Those anchors travel with the bytes of their windows to the task of their hash.
   Inside a chunk, anchors with the same bytes around them are sent once: all but the
   first are repeats of the first.
3. A task sorts the suffixes of an anchor hash (suffix array) and takes the common
   prefixes of neighbours (LCP array).  A stack scan emits the LCP intervals; inside
   each, the suffixes are ordered by their left contexts, read backwards, and a second
   scan emits the sets that share a left extension, distinct extensions apart.  Such
   a set with its left and right extensions is a maximal repeat with all occurrences.
4. Byte ranges of all but the first occurrence go back to the chunks.

A repeat longer than an anchor's windows is reported as overlapping repeats of
neighbouring anchors, so covered bytes are exact.  A suffix ends with its anchor's last
window, so intervals nest at most ``2 * min_len`` deep, whatever the number of suffixes.

Cases: null text is empty; texts under ``min_len`` bytes have no repeats; documents
are ordered by doc_id, null ids last, repeated ids (ties) by their place in the input;
repeated rows lose their bytes from the second on; a very long text is a chunk of its
own, searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, mapped, mix, pack, parts_for, ship, steps, texts_of, unpack, unzipped, zipped

GRAM = 32
CHUNK_BYTES = 6 << 20
_SEGMENT, _INDEX_BITS = 1 << 20, np.uint64(20)
_LAST_ID = np.iinfo(np.int64).max
_CHUNK = "chunk long, doc_ids binary, has_id binary, lens binary, text binary"
_NEAR = "chunk long, part int, hashes binary, docs binary, positions binary, places binary, lefts binary, rights binary, contexts binary"


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents in order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, rows = 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: _LAST_ID if r[0] is None else r[0])
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([(TaskContext.get().partitionId() << 24) + made]), "doc_ids": [pack(np.array([r[0] or 0 for r in rows], np.int64))], "has_id": [pack(np.array([r[0] is not None for r in rows], np.uint8))],
                "lens": [pack(np.array([len(r[1]) for r in rows], np.int64))], "text": [zipped(b"".join(r[1] for r in rows))],
            })

        for step in steps(batches, "text"):
            for doc, text in zip(step.column("doc_id").to_pylist(), texts_of(step.column("text")), strict=True):
                rows.append((doc, text))
                held += len(text)
                if held >= CHUNK_BYTES:
                    yield from flush()
                    made, held, rows = made + 1, 0, []
        if rows:
            yield from flush()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, _CHUNK)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = _BYTES[data]
    width = 1
    while width < GRAM:
        h = h[:-width] * _FACTORS[width] + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_FACTORS = {1 << k: mix(np.array([1000 + k], np.uint64))[0] | np.uint64(1) for k in range(6)}


def anchors(data: np.ndarray, lens: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first and last window start of every anchor, in order of place of the windows."""
    valid = np.zeros(len(data), bool)
    ends = np.cumsum(lens)
    for a, b in zip(ends - lens, ends, strict=True):
        if b - a >= min_len:
            valid[a : b - min_len + 1] = True
    grams = min_len - GRAM + 1
    low = (np.uint64(1) << _INDEX_BITS) - np.uint64(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(data) - min_len + 1, _SEGMENT - min_len):
        part = data[at : at + _SEGMENT]
        h = _gram_hashes(part)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        n = min(_SEGMENT - min_len, len(least))
        starts = np.flatnonzero(valid[at : at + n])
        own = (least[starts] & low).astype(np.int64)
        found.append((h[own], own + at, starts + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, place, start = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(place):
        return h, place, start, start
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[new], place[new], start[new], start[np.r_[new[1:] - 1, len(start) - 1]]


def _parts(hashes: np.ndarray, n_parts: int) -> list[tuple[int, np.ndarray]]:
    part = (mix(hashes) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(order) else []
    return [(int(part[x[0]]), x) for x in np.split(order, edges[1:])] if len(order) else []


_FILTER_BITS = np.uint64((1 << 48) - 1)  # hashes sent to find repeats; a false alarm costs time only


def _repeated(made: DataFrame, n_parts: int, min_len: int) -> DataFrame:
    """chunk, part, bits: which of the chunk's anchors in that part have a hash that occurs again."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lens, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lens", "text")), strict=True):
                hashes = anchors(np.frombuffer(unzipped(text), np.uint8), unpack(lens), min_len)[0]
                split = _parts(hashes, n_parts)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(split), pa.int64()), "part": pa.array([p for p, _ in split], pa.int32()), "hashes": pa.array([pack(hashes[at] & _FILTER_BITS) for _, at in split], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        hashes = [unpack(b) for b in table.column("hashes").to_pylist()]
        _, place, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        bits = np.split(counts[place] > 1, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array([pack(b.astype(np.uint8)) for b in bits], pa.binary())})

    asked = mapped(made.select("chunk", "lens", "text"), ask, "chunk long, part int, hashes binary")
    return grouped(asked, ["part"], answer, "chunk long, part int, bits binary")


def _near(n_parts: int, min_len: int, collapse: bool):
    """The windows' bytes of repeated anchors, by part; part -1 holds ranges that are repeats inside the chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        text, lens = unzipped(row["text"]), unpack(row["lens"])
        hashes, place, first, last = anchors(np.frombuffer(text, np.uint8), lens, min_len)
        bits = dict(zip(right.column("part").to_pylist(), right.column("bits").to_pylist(), strict=True))
        ids = np.where(unpack(row["has_id"]) > 0, unpack(row["doc_ids"]), _LAST_ID)
        ends = np.cumsum(lens)
        out: dict[str, list] = {f.split()[0]: [] for f in _NEAR.split(", ")}
        gone: list[tuple[int, int]] = []
        for part, at in _parts(hashes, n_parts):
            at = np.sort(at[unpack(bits[part]).astype(bool)])
            kept, seen, contexts = [], set(), []
            for i, p, a, b in zip(at.tolist(), place[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True):
                context = text[a : b + min_len]
                if collapse:
                    if (context, p - a) in seen:
                        gone.append((a, b + min_len))
                        continue
                    seen.add((context, p - a))
                kept.append(i)
                contexts.append(context)
            if not kept:
                continue
            at = np.array(kept)
            doc = np.searchsorted(ends, place[at], side="right")
            values = (row["chunk"], part, pack(hashes[at]), pack(ids[doc]), pack(place[at] - (ends - lens)[doc]), pack(place[at]), pack((place[at] - first[at]).astype(np.uint32)), pack((last[at] + min_len - place[at]).astype(np.uint32)), zipped(b"".join(contexts)))
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        if gone:
            a, b = np.array(gone).T
            for name, value in zip(out, (row["chunk"], -1, None, None, None, pack(a), pack(b), None, None), strict=True):
                out[name].append(value)
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.table({n: pa.array(out[n], kinds[k]) for n, k in (f.split() for f in _NEAR.split(", "))})

    return run


def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each LCP interval over suffixes 0..n, lcp[i] between i and i + 1, by a stack scan."""
    stack: list[list[int]] = []
    for i, length in enumerate([*lcp, 0]):
        start = i
        while stack and stack[-1][0] > length:
            high, start = stack.pop()
            yield high, start, i
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append([length, start])


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def maximal_repeats(suffixes: list[bytes], lefts: list[bytes], min_len: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left length, right length, members) of each maximal repeat among suffixes with reversed left contexts."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    lcp = [_common(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:], strict=False)]
    for right, a, b in lcp_intervals(lcp, GRAM):
        members = sorted(order[a : b + 1], key=lefts.__getitem__)
        shared = [_common(lefts[x], lefts[y]) for x, y in zip(members, members[1:], strict=False)]
        least = max(0, min_len - right)
        if least == 0:
            yield 0, right, members
        for left, c, d in lcp_intervals(shared, max(1, least)):
            yield left, right, members[c : d + 1]


def _groups_of(table: pa.Table) -> Iterator[tuple[list[tuple], list[bytes], list[bytes]]]:
    """Per anchor hash that occurs twice: occurrences (doc, position, chunk, place), suffixes and reversed left contexts."""
    cols: dict[str, list[np.ndarray]] = {c: [unpack(b) for b in table.column(c).to_pylist()] for c in ("hashes", "docs", "positions", "places", "lefts", "rights")}
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(h) for h in cols["hashes"]])
    merged = {c: np.concatenate(v) for c, v in cols.items()}
    texts = b"".join(unzipped(b) for b in table.column("contexts").to_pylist())
    size = merged["lefts"].astype(np.int64) + merged["rights"]
    ends = np.cumsum(size)
    order = np.argsort(merged["hashes"], kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(merged["hashes"][order]) != 0, True]) if len(order) else np.zeros(1, int)
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > 1:
            at = order[a:b]
            rows, suffixes, lefts = [], [], []
            fields = (merged["docs"][at], merged["positions"][at], chunk[at], merged["places"][at], ends[at] - size[at], merged["lefts"][at], ends[at])
            for doc, position, c, place, begin, left, end in zip(*(f.tolist() for f in fields), strict=True):
                rows.append((doc, position, c, place))
                suffixes.append(texts[begin + left : end])
                lefts.append(texts[begin : begin + left][::-1])
            yield rows, suffixes, lefts


def _ranges(min_len: int):
    """Per chunk the byte ranges that repeat an earlier occurrence."""

    def run(table: pa.Table) -> pa.Table:
        gone: dict[int, list[tuple[int, int]]] = {}
        for rows, suffixes, lefts in _groups_of(table):
            for left, right, members in maximal_repeats(suffixes, lefts, min_len):
                earliest = min(members, key=rows.__getitem__)
                for m in members:
                    if m != earliest:
                        gone.setdefault(rows[m][2], []).append((rows[m][3] - left, rows[m][3] + right))
        ranges = [np.array(r).T for r in gone.values()]
        return pa.table({"chunk": pa.array(gone, pa.int64()), "starts": pa.array([pack(r[0]) for r in ranges], pa.binary()), "ends": pa.array([pack(r[1]) for r in ranges], pa.binary())})

    return run


def _prepared(docs: DataFrame, min_len: int, collapse: bool) -> tuple[Scratch, DataFrame, DataFrame]:
    spark = docs.sparkSession
    scratch, n_parts = Scratch(spark, "repeats"), parts_for(docs)
    ship(spark)
    made = scratch.keep(chunks(docs), "chunks")
    repeated = scratch.keep(_repeated(made, n_parts, min_len), "repeated")
    near = made.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_near(n_parts, min_len, collapse), _NEAR)
    near = scratch.keep(near, "near")
    scratch.drop("repeated")
    return scratch, made, near


def repeat_groups(docs: DataFrame, min_len: int = 100) -> DataFrame:
    """All maximal repeats of at least min_len bytes: text (binary), occurrences array<struct<doc_id, start>>.

    A repeat longer than the windows of one anchor comes as overlapping repeats.
    """
    _, _, near = _prepared(docs, min_len, collapse=False)

    def run(table: pa.Table) -> pa.Table:
        texts, places = [], []
        for rows, suffixes, lefts in _groups_of(table):
            for left, right, members in maximal_repeats(suffixes, lefts, min_len):
                m = members[0]
                texts.append(lefts[m][:left][::-1] + suffixes[m][:right])
                places.append([{"doc_id": None if rows[x][0] == _LAST_ID else rows[x][0], "start": rows[x][1] - left} for x in sorted(members, key=rows.__getitem__)])
        return pa.table({"text": pa.array(texts, pa.binary()), "occurrences": pa.array(places, pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64())])))})

    return grouped(near.where("part >= 0"), ["part"], run, "text binary, occurrences array<struct<doc_id: long, start: long>>")


def without_repeats(docs: DataFrame, finish: Callable[[int | None, bytes, np.ndarray], tuple], schema: str, min_len: int = 100) -> DataFrame:
    """Calls finish(doc_id, text, removed byte mask) for every document and returns its rows."""
    scratch, made, near = _prepared(docs, min_len, collapse=True)
    found = grouped(near.where("part >= 0"), ["part"], _ranges(min_len), "chunk long, starts binary, ends binary")
    inside = near.where("part < 0").select("chunk", F.col("places").alias("starts"), F.col("lefts").alias("ends"))
    ranges = scratch.keep(found.unionByName(inside), "ranges")
    scratch.drop("near")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        text, lens, has_id = unzipped(row["text"]), unpack(row["lens"]), unpack(row["has_id"])
        delta = np.zeros(len(text) + 1, np.int32)
        for starts, ends in zip(right.column("starts").to_pylist(), right.column("ends").to_pylist(), strict=True):
            np.add.at(delta, unpack(starts), 1)
            np.add.at(delta, unpack(ends), -1)
        removed = np.cumsum(delta, out=delta)[:-1] > 0
        at, rows = 0, []
        for doc, known, n in zip(unpack(row["doc_ids"]).tolist(), has_id, lens.tolist(), strict=True):
            rows.append(finish(doc if known else None, text[at : at + n], removed[at : at + n]))
            at += n
        return pa.table({name: pa.array(c, kind) for name, kind, c in zip(names, arrow, zip(*rows, strict=True), strict=True)})

    return made.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(run, schema)


def removal_digest(doc_id: int | None, text: bytes, removed: np.ndarray) -> tuple:
    kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
    spans = int((removed & ~np.r_[False, removed[:-1]]).sum()) if len(removed) else 0
    return doc_id, len(text), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()
