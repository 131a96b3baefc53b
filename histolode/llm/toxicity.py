"""Toxicity by weak supervision.

1. Lexicons: words and 5-letter word beginnings whose share among toxic labelled training
   texts is beyond chance (their number with the same counts must be several
   times the number that random labels would give).
2. Voters: the lexicon is dealt by hash into word voters and beginning voters, each
   voting toxic or abstaining; two voters want several hits; pattern voters look at shouting, punctuation, address
   and repetition; coverage voters vote clean.
3. Label model: EM over the votes estimates the class share and each voter's
   class-conditional votes, without labels; correlations that the class does not
   explain are estimated from the residuals, and correlated voters share their weight.
4. A logistic regression on lexicon counts, votes and patterns is trained on the
   posterior labels and scores every text.

The voters and the classifier are fitted on at most ``max_labelled`` labelled rows
(those of the smallest id hashes), everything else covers all rows.  Of copies and near
copies (texts that share their least shingle hash, which unrelated texts hardly do) one
row is learnt from.

Cases: null text is empty; unlabelled, conflicting (any toxic label counts) and
repeated labels are allowed, null labels are skipped; without toxic training rows
every score is 0; repeated rows get equal scores; rows without id are scored; ties of
strength go by the term; a very long text is counted whole, in a step of its own; an
empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mapped, pack, steps, texts_of, unpack
from .near_dup import WordHashes, shingle_set

WORD = re.compile(r"[^\W\d_]{2,}")
PREFIX = 5
MIN_SHARE, MIN_PRECISION = 0.015, 0.75
WORD_VOTERS, PREFIX_VOTERS = 24, 8
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|ihr|tu|toi|vous|tú|usted|eres)\b")
_REPEAT = re.compile(r"(.)\1{3,}")
N_PATTERNS, N_MANY, N_CLEAN = 6, 2, 2


def terms_of(text: str) -> Counter:
    """Counts of words, and of word beginnings marked with a leading '^'."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        if len(word) > PREFIX:
            out["^" + word[:PREFIX]] += n
    return out


def patterns(text: str) -> list[float]:
    n = max(1, len(text))
    letters = max(1, sum(map(str.isalpha, text)))
    return [
        sum(map(str.isupper, text)) / letters, text.count("!") / n * 50, text.count("?") / n * 50,
        min(3, len(_ADDRESS.findall(text.lower()))) / 3, min(3, sum(1 for _ in _REPEAT.finditer(text))) / 3, min(1.0, n / 20_000),
    ]


_CUTS = np.array([0.6, 0.5, 0.5, 0.3, 0.3, 2.0])


class Voters:
    """The fitted lexicon: terms to columns, and the votes of a text."""

    def __init__(self, terms: list[str]) -> None:
        self.column = {t: i for i, t in enumerate(terms)}
        self.voter = np.array([WORD_VOTERS + zlib.crc32(t.encode()) % PREFIX_VOTERS if t[0] == "^" else zlib.crc32(t.encode()) % WORD_VOTERS for t in terms], np.int64)
        self.words = frozenset(t for t in terms if t[0] != "^")
        self.starts = frozenset(t[1:] for t in terms if t[0] == "^")
        self.size = WORD_VOTERS + PREFIX_VOTERS + N_PATTERNS + N_MANY + N_CLEAN

    def hits(self, text: str) -> dict[int, int]:
        words = WORD.findall(text.lower())
        found: dict[int, int] = {}
        for w in words:
            if w in self.words:
                found[self.column[w]] = found.get(self.column[w], 0) + 1
        for w in set(words):
            if w[:PREFIX] in self.starts and len(w) > PREFIX:
                c = self.column["^" + w[:PREFIX]]
                found[c] = found.get(c, 0) + 1
        return found

    def votes(self, hits: dict[int, int], shown: list[float]) -> np.ndarray:
        out = np.zeros(self.size, np.int8)
        voters = self.voter[list(hits)] if hits else np.zeros(0, np.int64)
        out[voters] = 1
        at = WORD_VOTERS + PREFIX_VOTERS
        out[at : at + N_PATTERNS] = np.array(shown) > _CUTS
        at += N_PATTERNS
        words = int((voters < WORD_VOTERS).sum())
        out[at : at + N_MANY] = words >= 2, words >= 3
        at += N_MANY
        out[at] = -1 if not (voters < WORD_VOTERS).any() else 0
        out[at + 1] = -1 if not (voters >= WORD_VOTERS).any() else 0
        return out

    def features(self, hits: dict[int, int], shown: list[float], votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values: lexicon terms, then votes, then patterns, then 1."""
        m, v = len(self.column), self.size
        cols = np.array([*hits, *range(m, m + v), *range(m + v, m + v + N_PATTERNS + 1)], np.int64)
        return cols, np.array([*np.log1p(np.fromiter(hits.values(), float, len(hits))), *votes, *shown, 1.0])


def label_model(votes: np.ndarray, share: float, rounds: int = 60) -> np.ndarray:
    """Posterior probability of class 1 per row of votes in {-1, 0, 1}, starting from ``share``."""
    n, m = votes.shape
    cast = [(votes == v).astype(np.float32) for v in (-1, 0, 1)]
    score = votes.clip(0).sum(axis=1) + 0.01 * votes.sum(axis=1)
    posterior = np.where(score >= np.quantile(score, max(0.0, 1 - share)), 0.9, 0.05) * (votes.max(axis=1) > 0)
    weight = np.ones(m)
    for k in range(rounds):
        one, zero = posterior, 1 - posterior
        prior = np.clip(one.mean(), 1e-4, 0.5)
        p1, p0 = ((np.stack([y @ c for c in cast], axis=1) + 0.05) / (y.sum() + 0.15) for y in (one, zero))
        if k >= 5 and k % 5 == 0:
            # what the classes leave of the votes' correlation
            rest = (votes - (one[:, None] * (p1[:, 2] - p1[:, 0]) + zero[:, None] * (p0[:, 2] - p0[:, 0]))).astype(np.float32)
            with np.errstate(invalid="ignore", divide="ignore"):
                c = np.nan_to_num(np.corrcoef(rest.T))
            np.fill_diagonal(c, 0)
            weight = 1 / (1 + np.where(c > 0.1, c, 0).sum(axis=1))
        ratio = np.log(p1 / p0) * weight[:, None]
        odds = np.log(prior / (1 - prior)) + sum(c @ ratio[:, v] for v, c in enumerate(cast))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done:
            break
    return posterior


def train_linear(sparse: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray, width: int, target: np.ndarray, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by full-batch adaptive gradient steps.

    sparse: row, column and value of the first ``width`` features; dense: the others.
    """
    row, col, val = sparse
    w, squares = np.zeros(width + dense.shape[1]), np.full(width + dense.shape[1], 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], len(dense)) + dense @ w[width:]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.r_[np.bincount(col, val * error[row], width), error @ dense] / len(dense) + ridge * 0.01 * w
        squares += g * g
        w -= 0.5 * g / np.sqrt(squares)
    return w


def _significant(cells: dict[tuple[int, int], int], by_df: dict[int, int], share: float, factor: float = 6.0) -> list[tuple[int, int]]:
    """(toxic, other) counts that far more terms have than labels drawn at random would give."""
    out = []
    for (p, q), n in sorted(cells.items()):
        log_chance = _log_choose(p + q, p) + p * np.log(share) + q * np.log1p(-share)
        if n >= factor * by_df[p + q] * np.exp(log_chance):
            out.append((p, q))
    return out


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's 3-word shingles, which most copies of a text share."""
    hashes = WordHashes()
    for step in steps(batches, "text"):
        sets = (shingle_set(t, hashes, 3) for t in texts_of(step.column("text")))
        keys = [int(s[0].view(np.int64)) if len(s) else 0 for s in sets]
        yield pa.RecordBatch.from_arrays([*(step.column(c) for c in ("doc_id", "text")), step.column("toxic").cast(pa.int32()), pa.array(keys, pa.int64())], ["doc_id", "text", "toxic", "key"])


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, scratch: Scratch) -> DataFrame:
    """key, text, toxic: the labelled texts, one for each key; the same rows in every run.

    Of texts with one key the one of the smallest id (then text hash) stays, toxic if any of them is.
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_labelled rows
    known = scratch.keep(mapped(known.select(F.col("doc_id").cast("long"), "text", "toxic"), _keyed, "doc_id long, text string, toxic int, key long"), "known")
    own = F.struct("doc_id", F.xxhash64("text").alias("mark"))
    first = known.groupBy("key").agg(F.min(own).alias("own"), F.max("toxic").alias("toxic"))  # keys and ids move, no texts
    rows = known.drop("toxic").withColumn("own", own).join(F.broadcast(first), ["key", "own"])  # at most a row for each label
    return scratch.keep(rows.select("key", "text", "toxic").dropDuplicates(["key"]), "training")  # equal rows are left


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, max_terms: int = 8192) -> tuple[Voters, np.ndarray] | None:
    """Fits on at most max_labelled labelled rows of (doc_id, toxic); None without toxic rows.

    The lexicon holds the ``max_terms`` strongest of the significant terms.  What reaches
    the driver is bounded by these two: counts, terms, and packed votes of the rows.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = training_rows(docs, labels, max_labelled, scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            every = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_pydict({"term": pa.array(every, pa.string()), "pos": pa.array([pos[t] for t in every], pa.int64()), "neg": pa.array([neg[t] for t in every], pa.int64())})

        for step in steps(batches, "text"):
            for text, toxic in zip(step.column("text").to_pylist(), step.column("toxic").to_pylist(), strict=True):
                (pos if toxic else neg).update(terms_of(text or "").keys())
            if len(pos) + len(neg) > 300_000:
                yield rows()
                pos.clear(), neg.clear()
        yield rows()

    n_pos, n = (int(x or 0) for x in known.agg(F.count_if(F.col("toxic") > 0), F.count("*")).first())
    if not n_pos:
        scratch.drop()
        return None
    terms = scratch.keep(mapped(known.select("text", "toxic"), count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    share, least = n_pos / n, max(2, math.ceil(MIN_SHARE * n_pos))
    by_df = {r[0]: r[1] for r in terms.where((F.col("pos") >= 2) | (F.col("neg") >= 1)).groupBy(F.col("pos") + F.col("neg")).count().collect()}  # a row per document count
    likely = terms.where((F.col("pos") >= least) & (F.col("pos") >= F.lit(MIN_PRECISION) * (F.col("pos") + F.col("neg"))))
    cells = {(r["pos"], r["neg"]): r["count"] for r in likely.groupBy("pos", "neg").count().collect()}  # a row per pair of counts
    wanted = docs.sparkSession.createDataFrame(_significant(cells, by_df, share), "pos long, neg long")
    strength = F.col("pos") * F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5))
    lexicon = [r["term"] for r in likely.join(F.broadcast(wanted), ["pos", "neg"]).orderBy(strength.desc(), "term").limit(max_terms).collect()]
    voters = Voters(lexicon)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            found = [voters.hits(t or "") for t in step.column("text").to_pylist()]
            shown = [patterns(t or "") for t in step.column("text").to_pylist()]
            votes = np.stack([voters.votes(h, s) for h, s in zip(found, shown, strict=True)])
            sizes = np.array([len(h) for h in found], np.int32)
            cols, times = (np.array([x for h in found for x in each(h)], np.int32) for each in (dict.keys, dict.values))
            packed = (step.column("key").to_numpy(), sizes, cols, times, np.array(shown).ravel(), votes.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([pack(x)], pa.binary()) for x in packed], ["key", "sizes", "cols", "times", "shown", "votes"])

    rows = mapped(known.select("key", "text"), sample, "key binary, sizes binary, cols binary, times binary, shown binary, votes binary").collect()  # packed votes of max_labelled rows
    scratch.drop()
    key, sizes, col, times, shown, votes = (np.concatenate(x) for x in zip(*([unpack(x) for x in r] for r in rows), strict=True))
    order = np.argsort(key)  # sums in one order, whatever the tasks'
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    shown, votes = shown.reshape(len(order), -1)[order], votes.reshape(len(order), -1)[order]
    posterior = label_model(votes, share)
    row, dense = np.repeat(place, sizes), np.c_[votes, shown, np.ones(len(order))].astype(np.float32)
    by = np.lexsort((col, row))
    return voters, train_linear((row[by], col[by], np.log1p(times[by]).astype(np.float32)), dense, len(lexicon), posterior)


def score(docs: DataFrame, model: tuple[Voters, np.ndarray] | None, name: str = "score") -> DataFrame:
    """The rows of docs with their score in a new column."""
    docs = docs.drop(name)
    columns = docs.columns
    schema = docs.withColumn(name, F.lit(0.0)).schema
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    voters, weights = model
    shipped = docs.sparkSession.sparkContext.broadcast((voters, weights))  # at most max_terms terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shipped.value
        for step in steps(batches, "text"):
            scores = []
            for text in step.column("text").to_pylist():
                text = text or ""
                hits, shown = own.hits(text), patterns(text)
                cols, vals = own.features(hits, shown, own.votes(hits, shown))
                scores.append(1 / (1 + np.exp(-np.clip(vals @ w[cols], -30, 30))))
            yield pa.RecordBatch.from_arrays([*(step.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, name])

    return mapped(docs, run, schema)
