"""Quality: a factorisation machine over hashed words, structure statistics and size metadata.

A text becomes a sparse vector: its words hashed to columns (log counts, of length one in all), and
statistics of its structure, each both as a number and as one column of a few bins, so that pairs of
bins interact. A factorisation machine scores it as

    b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

which is all pairwise interactions of low rank in time linear in the words.

It is fitted on a bounded sample of labelled rows of the training fold (``sample_rows``, chosen by a hash
of the id); only their sparse vectors, of at most ``COLUMNS`` numbers each, reach the driver. Every whole
text is scored. Without a sample of both labels all scores are the share of good ones, 0 if there are none.

Null and empty texts are scored like any other (all counts are nought); rows with a null id are scored
and not held out; repeated rows give repeated rows; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, lean, per_text, slices
from tidemark.llm.toxicity import fold, training_rows

HASHED = 2048
WORD = re.compile(r"[^\W_]+")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
STATISTICS = ("words", "chars", "lines", "distinct", "commonest", "stutter", "length", "upper", "symbols", "digits", "stops", "shouts", "pipes", "short_lines", "same_lines", "shapes")
#: Borders of the bins into which a statistic falls, all of which lie between 0 and 1.
BINS = (0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75)
COLUMNS = HASHED + len(STATISTICS) * (len(BINS) + 2)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Each brought to the range of 0 to 1."""
    n, chars = len(words) or 1, len(text) or 1
    tokens = text.split()
    lines = [s for s in text.split("\n") if s.strip()]
    m = len(tokens) or 1
    return [
        min(np.log1p(len(words)) / 12, 1), min(np.log1p(len(text)) / 14, 1), min(len(lines) / n, 1), len(counts) / n,
        (counts.most_common(1)[0][1] if counts else 0) / n, sum(map(str.__eq__, tokens, tokens[1:])) / m, min(sum(map(len, words)) / n / 20, 1),
        sum(t.isupper() and len(t) > 1 for t in tokens) / m, min(len(SYMBOL.findall(text)) / m, 1), sum(map(str.isdigit, tokens)) / m,
        min((text.count(".") + text.count(",")) / m, 1), min(text.count("!") / m, 1), min(text.count("|") / m, 1),
        sum(len(s) < 20 for s in lines) / (len(lines) or 1), 1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(sum(not t[-1].isalnum() and t[-1] not in ".,;:!?'\")" for t in tokens) / m, 1),
    ]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text."""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    hashed: Counter = Counter()
    for w, n in counts.items():
        hashed[zlib.crc32(w.encode("utf-8")) % HASHED] += n
    value = np.log1p(np.fromiter(hashed.values(), float, len(hashed)))
    value *= 0.5 / (np.sqrt((value**2).sum()) or 1)
    stats = np.array(statistics(text, words, counts))
    base = HASHED + np.arange(len(stats)) * (len(BINS) + 2)
    column = np.concatenate([np.fromiter(hashed, np.int64, len(hashed)), base, base + 1 + np.searchsorted(BINS, stats)])
    return column, np.concatenate([value, stats, np.full(len(stats), 0.5)])


class FactorisationMachine:
    def __init__(self, columns: int = COLUMNS, rank: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(columns), rng.normal(0, 0.02, (columns, rank))

    def raw(self, column: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores of rows laid end to end, each from its start; rows are never empty."""
        vx = self.v[column] * value[:, None]
        total = np.add.reduceat(vx, start)
        return self.bias + np.add.reduceat(self.w[column] * value, start) + 0.5 * (total**2 - np.add.reduceat(vx**2, start)).sum(1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> FactorisationMachine:
        """Adaptive gradient steps on the logistic loss."""
        rng = np.random.default_rng(5)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        sw, sv = np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                sizes = np.array([len(rows[i][0]) for i in part])
                column, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
                start = np.cumsum(sizes) - sizes
                error = (1 / (1 + np.exp(-self.raw(column, value, start))) - y[part]) / len(part)
                e = np.repeat(error, sizes)
                vx = self.v[column] * value[:, None]
                total = np.repeat(np.add.reduceat(vx, start), sizes, axis=0)
                self.bias -= rate * error.sum()
                used, to = np.unique(column, return_inverse=True)
                gw = np.bincount(to, e * value) + decay * self.w[used]
                gv = np.column_stack([np.bincount(to, g) for g in ((e * value)[:, None] * (total - vx)).T]) + decay * self.v[used]
                sw[used] += gw**2
                sv[used] += gv**2
                self.w[used] -= rate * gw / np.sqrt(sw[used])
                self.v[used] -= rate * gv / np.sqrt(sv[used])
        return self


class Model:
    def __init__(self, machine: FactorisationMachine | None, share: float):
        self.machine, self.share = machine, share

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.machine is None or not texts:
            return np.full(len(texts), self.share)
        rows = [vector(t) for t in texts]
        sizes = np.array([len(c) for c, _ in rows])
        raw = self.machine.raw(np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", sample_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = training_rows(docs, labels, training, label, sample_rows, id_col, text_col)
    arrow = arrow_schema(T._parse_datatype_string("id bigint, y int, cols array<int>, vals array<float>"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20):
                both = [vector(t or "") for t in part.column(1).to_pylist()]
                cols = [part.column(0).cast(pa.int64()), part.column(2), pa.array([c for c, _ in both], arrow.field(2).type), pa.array([v.astype(np.float32) for _, v in both], arrow.field(3).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    got = rows.mapInArrow(lean(run), "id bigint, y int, cols array<int>, vals array<float>").toArrow().sort_by("id")
    y = got["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(None, float(y.mean()) if len(y) else 0.0)
    c, v = got["cols"].combine_chunks(), got["vals"].combine_chunks()
    cut = c.offsets.to_numpy()
    column, value = c.values.to_numpy(), v.values.to_numpy()
    vectors = [(column[a:b], value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return Model(FactorisationMachine().fit(vectors, y), float(y.mean()))


def scored(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted. Labels of held-out rows are not learned from."""
    out = fold(id_col, parts) == held
    model = train(docs, labels, ~out, label, id_col=id_col, text_col=text_col)
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, score double"
    arrow = arrow_schema(T._parse_datatype_string(schema))
    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(per_text(lambda: lambda texts: {"score": told.value.scores(texts)}, arrow)), schema)
    return rows.select(id_col, F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
