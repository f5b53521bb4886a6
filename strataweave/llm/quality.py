"""Quality classifier by co-training a text-content view and a page-metadata view.

The content view reads the text only (its words and how it is written), the metadata view the columns beside it and
never the text. Both start from labelled documents. In a round each view judges
every document of the corpus without a label, in one pass; of those it is
confident about, some of each kind, drawn by hash over the whole corpus, become
pseudo-labels of the other view. Labelled documents kept apart from all rounds
calibrate how the two views are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import Workspace, fresh

#: Labelled documents that the fit reads, about; chosen by hash.
LABELLED = 6000
ROUNDS = 2
#: Pseudo-labels of each kind that a view gives the other in a round, at most; drawn among all confident documents.
EXCHANGE = 500
CONFIDENT = 0.95
#: Share of good calibration documents that may be rejected.
MISS = 0.01
DIMENSIONS = 1 << 16
CATEGORIES = 256
STEPS = 80
_U = np.uint64

_KIND = np.full(256, 2, np.uint8)
_KIND[at._SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_ANY = (at.constants(61, 256) | _U(1))[at._LOWER]


def content(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct hashed words and punctuation runs, as feature numbers."""
    n = len(offsets) - 1
    kind = _KIND[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(raw))
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    feature = (at.run_hashes(raw, start, end, _ANY) & _U(DIMENSIONS - 1)).astype(np.int32)
    mark = np.searchsorted(start, offsets)
    return [np.unique(feature[mark[i] : mark[i + 1]]) for i in range(n)]


def layout(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How each text is written: its lines, words, letters, digits, symbols and repeats."""
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(np.float64)
    size = np.maximum(np.diff(offsets), 1)
    solid = ~at._SPACE[raw]
    before = np.concatenate([[False], solid[:-1]]) if len(raw) else solid
    words = np.maximum(total(solid & ~before), 1)
    lines = total(raw == 10) + 1
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    same = np.zeros(len(raw), bool)
    same[1:] = (raw[1:] == raw[:-1]) & ~at._SPACE[raw[1:]]
    shares = [total(x) / size for x in (upper, digit, _KIND[raw] == 2, _KIND[raw] == 1, same)]
    return np.stack([np.log1p(size), np.log1p(lines), np.log1p(size / lines), np.log1p(total(solid) / words), *shares], axis=1)


@lru_cache(maxsize=1 << 16)
def _category(place: int, value: str | None) -> int:
    text = np.frombuffer(f"{place}:{value}".encode(), np.uint8)
    return int(at.run_hashes(text, np.array([0]), np.array([len(text)]), _ANY)[0] % _U(CATEGORIES))


def metadata(source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    """Each page's numbers and its two hashed categories, from the columns beside the text."""
    given = np.array([float(x) if x is not None else -1.0 for x in n_chars])
    size = np.log1p(np.maximum(given, 0))
    numbers = np.stack([size, size * size, (given < 0).astype(float)], axis=1)
    return numbers, np.array([[_category(0, s), _category(1, g)] for s, g in zip(source, lang, strict=True)], np.int64).reshape(len(given), 2)


@dataclass
class View:
    """Logistic regression over sparse binary and dense standardised features."""

    sparse: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float = 0.0

    def logit(self, index: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        count = np.diff(starts)
        out = np.full(len(count), self.bias)
        if len(index):
            sums = np.concatenate([[0.0], np.cumsum(self.sparse[index])])
            out += (sums[starts[1:]] - sums[starts[:-1]]) / np.sqrt(np.maximum(count, 1))
        if dense.shape[1]:
            out += np.clip((dense - self.mean) / self.scale, -8, 8) @ self.dense
        return out


def _fit(index: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray, dimensions: int) -> View:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *index]).astype(np.int64)
    view = View(np.zeros(dimensions), np.zeros(dense.shape[1]), dense.mean(axis=0) if len(dense) else np.zeros(dense.shape[1]), np.maximum(dense.std(axis=0), 1e-6) if len(dense) else np.ones(dense.shape[1]))
    x = np.clip((dense - view.mean) / view.scale, -8, 8)
    norm = 1 / np.sqrt(np.maximum(np.diff(starts), 1))
    per = np.repeat(norm, np.diff(starts))
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    g_sparse, g_dense, g_bias = np.full(dimensions, 1e-6), np.full(dense.shape[1], 1e-6), 1e-6
    for _ in range(STEPS):
        error = weight * (1 / (1 + np.exp(-view.logit(flat, starts, dense))) - y)
        step = np.bincount(flat, weights=error[row] * per, minlength=dimensions) + 1e-3 * view.sparse
        g_sparse += step * step
        view.sparse -= 0.5 * step / np.sqrt(g_sparse)
        step = x.T @ error + 1e-3 * view.dense
        g_dense += step * step
        view.dense -= 0.5 * step / np.sqrt(g_dense)
        step = error.sum()
        g_bias += step * step
        view.bias -= 0.5 * step / np.sqrt(g_bias)
    return view


@dataclass
class Classifier:
    text: View
    page: View
    mix: np.ndarray
    threshold: float

    def score(self, raw: np.ndarray, offsets: np.ndarray, source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability that a page is good, and both views' logits."""
        numbers, category = metadata(source, lang, n_chars)
        a, b = _logits(self.text, self.page, content(raw, offsets), layout(raw, offsets), numbers, category)
        return 1 / (1 + np.exp(-(self.mix[0] * a + self.mix[1] * b + self.mix[2]))), a, b


def _starts(index: list) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)


def _logits(text: View, page: View, index: list[np.ndarray], form: np.ndarray, numbers: np.ndarray, category: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = text.logit(np.concatenate([np.zeros(0, np.int64), *index]).astype(np.int64), _starts(index), form)
    b = page.logit(category.ravel(), np.arange(len(category) + 1) * 2, numbers)
    return a, b


def _views(rows: "_Rows", labels: list[np.ndarray], given: np.ndarray) -> tuple[View, View]:
    """Both views fitted on what each is labelled with; pseudo-labels weigh half."""
    out = []
    for k, own in enumerate(labels):
        use = np.flatnonzero(own >= 0)
        trust = np.where(given[use] >= 0, 1.0, 0.5)
        if k == 0:
            out.append(_fit([rows.index[i] for i in use], rows.form[use], own[use], trust, DIMENSIONS))
        else:
            out.append(_fit(list(rows.category[use]), rows.numbers[use], own[use], trust, CATEGORIES))
    return out[0], out[1]


def calibrate(views: tuple[View, View], rows: "_Rows", y: np.ndarray, miss: float = MISS) -> Classifier:
    """How the views are added, by a ridge logistic regression on labelled rows that no round has seen."""
    a, b = _logits(*views, rows.index, rows.form, rows.numbers, rows.category)
    scale = max(1.0, float(np.abs(a).mean())), max(1.0, float(np.abs(b).mean()))
    z = np.stack([a / scale[0], b / scale[1], np.ones(len(y))], axis=1)
    w = np.array([1.0, 1.0, 0.0])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3), z.T @ (p - y) + 1e-2 * (w - [1, 1, 0]))
    good = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))[y == 1]
    threshold = min(0.5, float(np.quantile(good, miss))) if len(good) else 0.0
    return Classifier(*views, np.array([w[0] / scale[0], w[1] / scale[1], w[2]]), threshold)


_INPUT = ["source", "lang", "n_chars"]


@dataclass
class _Rows:
    """Featurised documents on the driver; their number is bounded by the fit's parameters."""

    ids: np.ndarray
    index: list[np.ndarray]
    form: np.ndarray
    numbers: np.ndarray
    category: np.ndarray

    def take(self, where: np.ndarray) -> "_Rows":
        return _Rows(self.ids[where], [self.index[i] for i in np.flatnonzero(where)], self.form[where], self.numbers[where], self.category[where])

    def join(self, other: "_Rows") -> "_Rows":
        return _Rows(np.append(self.ids, other.ids), self.index + other.index, *[np.concatenate(x) for x in ((self.form, other.form), (self.numbers, other.numbers), (self.category, other.category))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = at.utf8(batch.column("text"))
        given = [batch.column(c).to_pylist() for c in _INPUT]
        for a, b in at.slices(off):
            numbers, category = metadata(*(x[a:b] for x in given))
            part, bound = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            words, form = content(part, bound), layout(part, bound)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("good").slice(a, b - a), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(form.tolist(), pa.list_(pa.float64())), pa.array(numbers.tolist(), pa.list_(pa.float64())), pa.array(category.tolist(), pa.list_(pa.int64()))],
                names=["doc_id", "good", "words", "form", "numbers", "category"],
            )


def _fetch(rows: DataFrame, chosen: DataFrame) -> tuple[_Rows, np.ndarray]:
    """Features and labels of chosen documents (doc_id, good), in order of id; rows that repeat an id give one of them."""
    # Chosen ids are bounded by the fit's parameters; one row an id is picked before anything moves.
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", *_INPUT), F.xxhash64("text", *_INPUT)).alias("r"), F.min("good").alias("good"))
    got = one.select("doc_id", "good", "r.*").mapInArrow(_features, "doc_id long, good int, words binary, form array<double>, numbers array<double>, category array<bigint>").toArrow().sort_by("doc_id")
    n = got.num_rows
    index = [np.frombuffer(x, np.int32) for x in got.column("words").to_pylist()]
    if n == 0:
        form, (numbers, category) = layout(np.zeros(0, np.uint8), np.zeros(1, np.int64)), metadata([], [], [])
    else:
        form, numbers, category = (np.array(got.column(c).to_pylist()) for c in ("form", "numbers", "category"))
    return _Rows(got.column("doc_id").to_numpy(), index, form, numbers, category.astype(np.int64)), got.column("good").to_numpy().astype(np.int64)


def _shape(docs: DataFrame, id_col: str) -> DataFrame:
    given = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("text", *_INPUT)}
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), *[given[c].cast(kinds[c]).alias(c) for c in kinds])


def _judge(views: tuple[View, View], bound: float):
    """Ids of which a view is confident, with both views' logits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = at.utf8(batch.column("text"))
            given = [batch.column(c).to_pylist() for c in _INPUT]
            for a, b in at.slices(off):
                numbers, category = metadata(*(x[a:b] for x in given))
                part, edge = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                x, y = _logits(*views, content(part, edge), layout(part, edge), numbers, category)
                sure = (np.abs(x) > bound) | (np.abs(y) > bound)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).filter(pa.array(sure)), pa.array(x[sure]), pa.array(y[sure])], names=["doc_id", "view0", "view1"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, rounds: int = ROUNDS, exchange: int = EXCHANGE, id_col: str = "doc_id", good_col: str = "good") -> Classifier | None:
    """Classifier from about ``labelled`` rows of labels (id, 0/1), chosen by hash, and ``rounds`` passes over all other documents.

    A quarter of the labelled documents calibrates and is seen by no round. What
    reaches the driver is bounded by ``labelled`` and 4 * ``rounds`` * ``exchange``
    documents; which of them become pseudo-labels is decided over the whole
    corpus. Contradicting labels of one id count as bad, rows that repeat an id
    teach once, null ids teach nothing. None unless both kinds of labels occur.
    """
    work = Workspace(docs.sparkSession)
    clean = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).try_cast("long").alias("doc_id")).agg(F.min(F.col(good_col).cast("int")).alias("good"))
    draw = F.pmod(F.xxhash64(F.lit(71), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = work.keep(clean.where(draw * F.lit(float(clean.count())) < labelled), "sample")
    rows = _shape(docs, id_col)
    found, y = _fetch(rows, sample)
    if not ((y == 1).any() and (y == 0).any()):
        return None
    hold = np.arange(len(y)) % 4 == 3
    if not ((y[~hold] == 1).any() and (y[~hold] == 0).any() and hold.any()):
        hold = np.zeros(len(y), bool)
    test, truth = (found.take(hold), y[hold]) if hold.any() else (found, y)
    pool, given = found.take(~hold), y[~hold]
    taught = [given.copy(), given.copy()]  # what each view is fitted on: 1 good, 0 bad, -1 nothing
    views = _views(pool, taught, given)
    free = rows.where("doc_id IS NOT NULL").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    bound = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    for round_ in range(rounds):
        judged = work.keep(free.mapInArrow(_judge(views, bound), "doc_id long, view0 double, view1 double"), f"judged-{round_}")
        picks = None
        for k in range(2):
            for kind, sign in ((1, 1), (0, -1)):
                some = judged.where(F.col(f"view{k}") * sign > bound).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(round_), "doc_id"), "doc_id").limit(exchange)
                part = some.select("doc_id", F.lit(k).alias("view"), F.lit(kind).alias("kind"))
                picks = part if picks is None else picks.unionByName(part)
        chosen = picks.toPandas()
        fresh = sorted(set(chosen["doc_id"]) - set(pool.ids.tolist()))
        if fresh:
            more, _ = _fetch(rows, docs.sparkSession.createDataFrame([(int(d), -1) for d in fresh], "doc_id long, good int"))
            pool, none = pool.join(more), np.full(len(more.ids), -1, np.int64)
            given, taught = np.append(given, none), [np.append(t, none) for t in taught]
        place = {int(d): i for i, d in enumerate(pool.ids)}
        for d, view, kind in zip(chosen["doc_id"], chosen["view"], chosen["kind"], strict=True):
            if taught[1 - view][place[int(d)]] < 0:
                taught[1 - view][place[int(d)]] = kind
        views = _views(pool, taught, given)
        work.drop(f"judged-{round_}")
    return calibrate(views, test, truth)


def _score(model: Classifier | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = at.utf8(batch.column("text"))
            given = [batch.column(c).to_pylist() for c in _INPUT]
            n = batch.num_rows
            score, a_, b_ = np.full(n, 0.5), np.zeros(n), np.zeros(n)
            for a, b in at.slices(off) if model else ():
                score[a:b], a_[a:b], b_[a:b] = model.score(raw[off[a] : off[b]], off[a : b + 1] - off[a], *(x[a:b] for x in given))
            kept = score >= (model.threshold if model else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(kept), pa.array(a_), pa.array(b_)], names=["doc_id", "score", "kept", "text_logit", "page_logit"])

    return run


def classify(docs: DataFrame, model: Classifier | None, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, kept, text_logit, page_logit: one row per input row.

    ``score`` is the calibrated probability that the page is good. Null texts
    count as empty, missing or null metadata as a category of its own; very long
    texts are read whole. Without a model every row has score 0.5 and is kept.
    Repeated rows score alike, a score equal to the threshold keeps, other columns
    are ignored, and an id that is no number comes out as null.
    """
    return _shape(docs, id_col).mapInArrow(_score(model), "doc_id long, score double, kept boolean, text_logit double, page_logit double")


def _keep(model: Classifier, read: dict[str, str], extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = at.utf8(batch.column(read["text"]))
            given = [batch.column(read[c]).to_pylist() for c in _INPUT]
            good = np.zeros(batch.num_rows, bool)
            for a, b in at.slices(off):
                good[a:b] = model.score(raw[off[a] : off[b]], off[a : b + 1] - off[a], *(x[a:b] for x in given))[0] >= model.threshold
            yield batch.drop_columns(extra).filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns, in one pass; without a model all rows.

    A column that is there with the right type is read as it is; others travel as casts
    beside the input, under names that no column has. Ids play no part: null, repeated
    and text ids are rows like others, equal rows share their fate. Null and empty texts
    are scored as empty ones, long texts whole, and an empty table stays empty.
    """
    if model is None:
        return docs
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    have = {f.name: f.dataType.simpleString() for f in docs.schema}
    read = {c: c if have.get(c) == k else fresh(f"_{c}", docs.columns) for c, k in kinds.items()}
    extra = [name for c, name in read.items() if name != c]
    wide = docs.withColumns({name: (F.col(c) if c in have else F.lit(None)).cast(kinds[c]) for c, name in read.items() if name != c}) if extra else docs
    return wide.mapInArrow(_keep(model, read, extra), docs.schema)
