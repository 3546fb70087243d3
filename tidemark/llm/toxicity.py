"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words, and stems of four to six letters, that labelled toxic texts have far more
often than others, in three tiers of strength. Features are the tiers' densities and counts, how many
such words stand near a word for the second person, capitals, exclamation marks, punctuation, and
disguised words (letters replaced by digits or signs, also looked up with the disguise undone).

Labels come from a bounded sample of the training fold (``sample_rows``, chosen by a hash of the id). The
lexicon and the trees are learned from all of it; the calibration is of scores by trees that have not seen
their rows, by fives. An entry must be more than chance among so many would give; the lexicon has all such
entries and is bounded by the sample alone. Texts are never sent to the driver, only lexicon entries and
feature rows are. Every whole text is scored. Without a sample of both labels all scores are the share of
toxic ones, 0 if there are none.

Null and empty texts get the score of their features like any other; rows with a null id are scored and
not held out; repeated rows give repeated rows; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, arrow_schema, lean, per_text, slices

#: Words for the second person, in the languages of the corpus, and disguises of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
DISGUISE = str.maketrans("013457@$!|*", "oieastasil\0")
TOKEN = re.compile(r"[^\s]+")
WORD = re.compile(r"[^\W_]+")
TIERS = (6.5, 4.5, 3.0)
STEMS = (4, 5, 6)
#: Log-likelihood ratio below which an entry may be one of the many that differ by chance.
LEAST_SURPRISE = 24.0
MEMO = 200_000


def entries(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Scorer:
    """Features of a text, given the lexicon (entry to strength)."""

    names = ("tier1", "tier2", "tier3", "hits1", "hits2", "strongest", "second", "second_person", "near", "capitals", "shouts", "punctuation", "disguised", "disguised_hits", "words", "spread")

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def strength(self, word: str) -> float:
        s = self.memo.get(word)
        if s is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            s = self.memo[word] = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
        return s

    def __call__(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n = len(words) or 1
        counts = Counter(words)
        strong = {w: s for w in counts if (s := self.strength(w)) >= TIERS[-1]}
        tier = [0, 0, 0]
        for w, s in strong.items():
            tier[0 if s >= TIERS[0] else 1 if s >= TIERS[1] else 2] += counts[w]
        best = sorted(strong.values(), reverse=True)[:2] + [0.0, 0.0]
        near = 0
        if strong:
            persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            if persons:
                at = np.array(persons)
                hits = np.array([i for i, w in enumerate(words) if w in strong])
                k = np.searchsorted(at, hits)
                gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - hits), np.abs(at[np.maximum(k - 1, 0)] - hits))
                near = int((gap <= 5).sum())
        disguised = hidden = 0
        if re.search(r"[A-Za-z][013457@$!|*]+[A-Za-z]", text):
            for t in set(TOKEN.findall(text)):
                core = t.strip(".,;:!?\"'()")
                if re.search(r"[A-Za-z][013457@$!|*]+[A-Za-z]", core):
                    disguised += 1
                    hidden += self.strength(core.lower().translate(DISGUISE).replace("\0", "")) >= TIERS[1]
        chars = len(text) or 1
        letters = sum(map(len, words)) or 1
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        return [
            tier[0] / n, tier[1] / n, tier[2] / n, min(tier[0], 20), min(tier[1], 20), best[0], best[1],
            sum(counts[p] for p in SECOND_PERSON) / n, near / n, upper / letters, text.count("!") / n,
            (chars - letters - text.count(" ")) / chars, disguised / n, min(hidden, 5), math.log1p(len(words)), len(strong) / n,
        ]


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.forest = math.log(p / (1 - p)), []
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, p - y, np.maximum(p * (1 - p), 1e-6))
            self.forest.append(tree)
            raw = raw + self.rate * self._leaf(tree, b)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """Nodes in level order: (feature, bin, value); feature -1 is a leaf."""
        nodes = []
        where = {0: np.arange(len(b))}
        for node in range(2 ** (self.depth + 1) - 1):
            rows = where.get(node)
            if rows is None:
                nodes.append((-1, 0, 0.0))
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value, best = -total_g / (total_h + self.ridge), (1e-6, -1, 0)
            if node < 2**self.depth - 1:
                for f in range(b.shape[1]):
                    gs = np.cumsum(np.bincount(b[rows, f], g[rows], self.bins))[:-1]
                    hs = np.cumsum(np.bincount(b[rows, f], h[rows], self.bins))[:-1]
                    gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(hs < self.least) | (total_h - hs < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            nodes.append((best[1], best[2], value))
            if best[1] >= 0:
                left = b[rows, best[1]] <= best[2]
                where[2 * node + 1], where[2 * node + 2] = rows[left], rows[~left]
        return nodes

    def _leaf(self, nodes: list, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        feature, cut, value = (np.array(v) for v in zip(*nodes, strict=True))
        for _ in range(self.depth):
            f = feature[at]
            deeper = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]
            at = np.where(deeper, 2 * at + 1 + right, at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + self.rate * sum((self._leaf(t, b) for t in self.forest), np.zeros(len(x)))


class Isotonic:
    """A non-decreasing map to probabilities (pool adjacent violators), linear between the pools.

    A trace of the raw score keeps equal probabilities in order.
    """

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum of labels, weight, sum of scores
        for s, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            pools.append([t, 1.0, s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = np.array([p[2] / p[1] for p in pools])
        self.to = np.array([p[0] / p[1] for p in pools])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return 0.999 * np.interp(raw, self.at, self.to) + 0.001 / (1 + np.exp(-raw))


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, training: Column, label: str, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y, part) of a bounded sample of labelled rows, chosen by a hash of the id; part: 0 to 9."""
    picked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(training).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(picked), "id").select("id", "text", "y", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)).alias("part"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries with their log-odds between toxic and other texts of (id, text, y)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20):
                found, ys = [], []
                for text, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    new = {e for w in set(WORD.findall((text or "").lower())) for e in entries(w)}
                    found += new
                    ys += [y] * len(new)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ys, pa.int32())], names=["entry", "y"])

    total = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, other = total[0] or 0, total[1] or 0
    if not toxic or not other:
        return {}
    counts = rows.mapInArrow(lean(run), "entry string, y int").groupBy("entry").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    odds = F.log((F.col("p") + 0.1) / (toxic + 1)) - F.log((F.col("q") + 0.5) / (other + 1))
    share = (F.col("p") + F.col("q")) / (toxic + other)
    surprise = lambda n, of: F.when(F.col(n) > 0, 2 * F.col(n) * F.log(F.col(n) / (share * of))).otherwise(0.0)
    kept = counts.where("p >= 4").withColumn("odds", odds).where((F.col("odds") >= TIERS[-1]) & (surprise("p", toxic) + surprise("q", other) >= LEAST_SURPRISE))
    return {r["entry"]: r["odds"] for r in kept.collect()}


def featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    told = rows.sparkSession.sparkContext.broadcast(lexicon)
    arrow = arrow_schema(T._parse_datatype_string("y int, part bigint, x array<double>"))

    def run(batches):
        scorer = Scorer(told.value)
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20):
                x = [scorer(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(x, arrow.field(2).type)], schema=arrow)

    return rows.mapInArrow(lean(run), "y int, part bigint, x array<double>")


class Model:
    """Lexicon, trees and calibration together."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibrated: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibrated, self.share = lexicon, trees, calibrated, share

    def scorer(self):
        features = Scorer(self.lexicon)

        def scores(texts: list[str]) -> np.ndarray:
            if self.trees is None or not texts:
                return np.full(len(texts), self.share)
            return self.calibrated(self.trees.raw(np.array([features(t) for t in texts])))

        return scores


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", sample_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(training_rows(docs, labels, training, label, sample_rows, id_col, text_col), "sample")
    lexicon = learn_lexicon(rows)
    got = featured(rows, lexicon).collect()
    scratch.drop()
    if not got or len({r["y"] for r in got}) < 2:
        return Model(lexicon, None, None, float(np.mean([r["y"] for r in got])) if got else 0.0)
    got.sort(key=lambda r: (r["part"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    raw, turn = np.zeros(len(y)), np.empty(len(y), np.int64)
    for value in (0, 1):
        turn[y == value] = np.arange((y == value).sum()) % 5
    for k in range(5):
        if len(set(y[turn != k])) == 2 and (turn == k).any():
            raw[turn == k] = Trees().fit(x[turn != k], y[turn != k]).raw(x[turn == k])
    return Model(lexicon, Trees().fit(x, y), Isotonic(raw, y), float(y.mean()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, score double"
    arrow = arrow_schema(T._parse_datatype_string(schema))
    told = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = told.value.scorer()
        return lambda texts: {"score": scores(texts)}

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(per_text(make, arrow)), schema)


def scored(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.3, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted. Labels of held-out rows are not learned from."""
    out = fold(id_col, parts) == held
    model = train(docs, labels, ~out, label, id_col=id_col, text_col=text_col)
    rows = score(docs, model, id_col, text_col)
    return rows.select(id_col, F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns; labels as for ``scored``."""
    model = train(docs, labels, fold(id_col, 4) != 2, id_col=id_col, text_col=text_col)
    arrow, at = arrow_schema(docs.schema), docs.columns.index(text_col)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = told.value.scorer()
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20, at):
                clean = scores([t or "" for t in part.column(at).to_pylist()]) < threshold
                yield pa.RecordBatch.from_arrays(part.columns, schema=arrow).filter(pa.array(clean))

    return docs.mapInArrow(lean(run), docs.schema)
