"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

ORDER = 4
#: Documents of a language that its model is fitted on, about; whole texts, chosen by hash.
FIT_DOCS = 600
#: Further documents of a language that set the score's temperature and the rejection bound.
CALIBRATION_DOCS = 100
#: Languages that are fitted together, in the order of their names: what one fit brings to the driver stays bounded by it.
BLOCK = 200
#: Temperatures that calibration chooses from.
TEMPERATURES = np.array([2.0**k for k in range(-1, 9)])
DISCOUNT = 0.75
_START, _SPACE = 2, 32
_U = np.uint64
_C = at.constants(51, ORDER) | _U(1)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with single spaces between them, each text led by start marks; and its bounds (n+1)."""
    fold = fold_table()
    points = fold[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    bound = heads[offsets]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bound))
    letter = points != _SPACE
    keep = letter.copy()
    # One space before every letter that follows other characters or begins a text.
    gap = letter.copy()
    gap[1:] &= ~(letter[:-1] & (text[1:] == text[:-1]))
    width = np.where(keep, 1 + gap, 0)
    lead = ORDER - 1
    end = np.cumsum(width) + (text + 1) * lead if len(text) else np.zeros(0, np.int64)
    per_text = np.bincount(text, weights=width, minlength=len(offsets) - 1).astype(np.int64) if len(text) else np.zeros(len(offsets) - 1, np.int64)
    marks = np.concatenate([[0], np.cumsum(per_text + lead)])
    out = np.full(int(marks[-1]), _START, np.uint32)
    at_ = end[keep] - 1
    out[at_] = points[keep]
    out[at_[gap[keep]] - 1] = _SPACE
    return out, marks


def gram_keys(s: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of the grams that end at each position, the last symbol first."""
    x = s.astype(np.uint64)
    h = x * _C[0]
    for k in range(1, order):
        h[k:] += x[:-k] * _C[k] if k < len(x) else 0
    return at.mix64(h + _U(order))


def _key(gram: str) -> int:
    return int(gram_keys(np.array([ord(c) for c in gram], np.uint32), len(gram))[-1])


@dataclass
class Model:
    """Languages; for each order the sorted gram keys with log probabilities, and context keys with log back-off weights, a column a language."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    context_keys: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray

    def log_probabilities(self, s: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Log probability of the symbols at ``where``, a column a language."""
        total = np.zeros((len(where), len(self.languages)), np.float32)
        open_ = np.arange(len(where))
        for order in range(ORDER, 0, -1):
            keys = gram_keys(s, order)[where[open_]] if order < ORDER and len(open_) > len(s) // 8 else self._some(s, where[open_], order)
            place = np.minimum(np.searchsorted(self.keys[order - 1], keys), len(self.keys[order - 1]) - 1)
            hit = self.keys[order - 1][place] == keys
            total[open_[hit]] += self.logp[order - 1][place[hit]]
            open_ = open_[~hit]
            if len(open_) == 0:
                return total
            if order > 1:
                context = self._some(s, where[open_] - 1, order - 1)
                place = np.minimum(np.searchsorted(self.context_keys[order - 1], context), len(self.context_keys[order - 1]) - 1)
                hit = self.context_keys[order - 1][place] == context
                total[open_[hit]] += self.backoff[order - 1][place[hit]]
        total[open_] += self.unseen
        return total

    @staticmethod
    def _some(s: np.ndarray, where: np.ndarray, order: int) -> np.ndarray:
        h = np.zeros(len(where), np.uint64)
        for k in range(order):
            h += s[where - k].astype(np.uint64) * _C[k]
        return at.mix64(h + _U(order))


@dataclass
class Family:
    """Models of blocks of languages, all languages in the order of their names, and what calibration found for all of them."""

    models: list[Model]
    temperature: float = 20.0
    reject_above: float = float("inf")

    @property
    def languages(self) -> list[str]:
        return [x for m in self.models for x in m.languages]


def fit(grams: pd.DataFrame, alphabet: int) -> Model:
    """Interpolated Kneser-Ney from counts (lang, gram, n) of grams of ``ORDER`` symbols out of ``alphabet`` different ones."""
    languages = sorted(grams["lang"].unique().tolist())
    seen: list[set[str]] = [set() for _ in range(ORDER)]
    weights: list[list[dict[str, float]]] = []
    chances: list[list[dict[str, float]]] = []
    for lang in languages:
        top = dict(zip(*(grams.loc[grams["lang"] == lang, c].tolist() for c in ("gram", "n")), strict=True))
        counts = [Counter() for _ in range(ORDER)]
        counts[ORDER - 1].update(top)
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols on the left
            for g in counts[order]:
                counts[order - 1][g[1:]] += 1
        probs: list[dict[str, float]] = [{} for _ in range(ORDER)]
        back: list[dict[str, float]] = [{} for _ in range(ORDER)]
        for order in range(1, ORDER + 1):
            totals, kinds = defaultdict(float), Counter()
            for g, n in counts[order - 1].items():
                totals[g[:-1]] += n
                kinds[g[:-1]] += 1
            back[order - 1] = {c: DISCOUNT * kinds[c] / totals[c] for c in totals}
            for g, n in counts[order - 1].items():
                lower = 1 / (alphabet + 1) if order == 1 else probs[order - 2][g[1:]]
                probs[order - 1][g] = (n - DISCOUNT) / totals[g[:-1]] + back[order - 1][g[:-1]] * lower
            seen[order - 1].update(counts[order - 1])
        chances.append(probs)
        weights.append(back)

    def chance(k: int, g: str) -> float:
        if g in chances[k][len(g) - 1]:
            return chances[k][len(g) - 1][g]
        lower = 1 / (alphabet + 1) if len(g) == 1 else chance(k, g[1:])
        return weights[k][len(g) - 1].get(g[:-1], 1.0) * lower

    keys, logp, context_keys, backoff = [], [], [], []
    for order in range(1, ORDER + 1):
        names = list(seen[order - 1])
        own = np.array([_key(g) for g in names], np.uint64)
        sort = np.argsort(own)
        keys.append(own[sort])
        logp.append(np.log(np.array([[chance(k, names[i]) for k in range(len(languages))] for i in sort], np.float64)).astype(np.float32))
        names = list({c for w in weights for c in w[order - 1]})
        own = np.array([_key(c) if c else 0 for c in names], np.uint64)
        sort = np.argsort(own)
        context_keys.append(own[sort])
        backoff.append(np.log(np.array([[w[order - 1].get(names[i], 1.0) for w in weights] for i in sort], np.float64)).astype(np.float32))
    unseen = np.log([weights[k][0].get("", 1.0) / (alphabet + 1) for k in range(len(languages))]).astype(np.float32)
    return Model(languages, keys, logp, context_keys, backoff, unseen)


def entropies(family: Family, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol in nats of each text under each language, and its number of symbols."""
    n = len(offsets) - 1
    s, marks = symbols(raw, offsets)
    lead = ORDER - 1
    count = np.diff(marks) - lead
    where = np.flatnonzero(s != _START)
    out = np.zeros((n, len(family.languages)))
    full = count > 0
    if len(where):
        first, column = np.cumsum(count) - count, 0
        for model in family.models:
            logp = model.log_probabilities(s, where)
            out[full, column : column + len(model.languages)] = -np.add.reduceat(logp, first[full], axis=0, dtype=np.float64) / count[full][:, None]
            column += len(model.languages)
    return out, count


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            s, _ = symbols(raw, np.array([0, len(raw)]))
            line = s.astype("<u4").tobytes().decode("utf-32-le")
            counts[lang].update(map("".join, zip(*(line[k:] for k in range(ORDER)), strict=False)))
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])


def _score(model: Family | None):
    languages = model.languages if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, bits, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            raw, off = at.utf8(batch.column("text"))
            for a, b in at.slices(off) if model else ():
                entropy, count = entropies(model, raw[off[a] : off[b]], off[a : b + 1] - off[a])
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(b - a), best]
                share = 1 / np.exp(-model.temperature * (entropy - least[:, None])).sum(axis=1)
                for i in np.flatnonzero(count > 0):
                    lang[a + i], score[a + i], bits[a + i] = languages[best[i]], share[i], least[i] / np.log(2)
                    rejected[a + i] = least[i] > model.reject_above
            keep = [(c, x) for c, x in zip(batch.schema.names, batch.columns, strict=True) if c != "text"]
            yield pa.RecordBatch.from_arrays([*[x for _, x in keep], pa.array(lang), pa.array(score), pa.array(bits, from_pandas=True), pa.array(rejected)], names=[*[c for c, _ in keep], "lang_pred", "score", "bits_per_symbol", "rejected"])

    return run


def _losses(model: Family):
    """Of each text in a known language: its cross-entropy under that language, and the log loss at each of ``TEMPERATURES``."""
    index = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = at.utf8(batch.column("text"))
            own, losses, lang = [], [], batch.column("lang").to_pylist()
            for a, b in at.slices(off):
                entropy, count = entropies(model, raw[off[a] : off[b]], off[a : b + 1] - off[a])
                for i in np.flatnonzero(count > 0):
                    if (k := index.get(lang[a + i])) is not None:
                        x = -TEMPERATURES[:, None] * (entropy[i] - entropy[i].min())
                        own.append(float(entropy[i, k]))
                        losses.append((np.log(np.exp(x).sum(axis=1)) - x[:, k]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.float64()), pa.array(losses, pa.list_(pa.float64()))], names=["own", "losses"])

    return run


def train(labelled: DataFrame, *, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS, block: int = BLOCK) -> Family | None:
    """Models from (doc_id, lang, text) rows with a language, one for every language; None if there are none.

    The fit reads whole texts of about ``fit_docs`` documents of each language,
    chosen by a hash of id and text, ``block`` languages at a time; what reaches
    the driver is bounded by these numbers and the number of languages, not by the
    corpus. The share of a symbol that a language has never seen rests on the
    symbols of all blocks, so that blocks compare. Rows with a null language, null
    and empty texts teach nothing; repeated rows are drawn together.
    """
    labelled = labelled.select("doc_id", "lang", "text").where("lang is not null")
    counts = sorted((r["lang"], r["_n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("_n")).collect())
    draw = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)

    def drawn(part: list[tuple[str, int]]) -> DataFrame:
        # At most ``block`` rows are broadcast.
        sizes = labelled.sparkSession.createDataFrame(part, "lang string, _n long")
        return labelled.join(F.broadcast(sizes), "lang").withColumn("rank", draw * F.col("_n")).where(F.col("rank") < fit_docs + calibration_docs)

    def counted(chosen: DataFrame) -> DataFrame:
        rows = chosen.where(F.col("rank") < fit_docs).select("lang", "text").mapInArrow(_grams, "lang string, gram string, n long")
        return rows.where(F.substring("gram", -1, 1) != chr(_START)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    parts = [drawn(counts[i : i + block]) for i in range(0, len(counts), block)]
    known = {chr(_START)}
    if len(parts) > 1:
        for part in parts:
            known |= {r[0] for r in counted(part).select(F.substring("gram", -1, 1)).distinct().collect()}
    models = []
    for part in parts:
        grams = counted(part).toPandas()
        if not grams.empty:
            models.append(fit(grams, len(known) if len(parts) > 1 else len(known | {c for g in grams["gram"] for c in g})))
    if not models:
        return None
    family = Family(models)
    rows = [r for part in parts for r in part.where(F.col("rank") >= fit_docs).select("lang", "text").mapInArrow(_losses(family), "own double, losses array<double>").collect()]
    if rows:
        own = np.array([r["own"] for r in rows])
        family.temperature = float(TEMPERATURES[np.array([r["losses"] for r in rows]).mean(axis=0).argmin()])
        family.reject_above = float(np.quantile(own, 0.99) + 2 * own.std())
    return family


OUTPUTS = ["lang_pred", "score", "bits_per_symbol", "rejected"]


def predict(docs: DataFrame, model: Family | None) -> DataFrame:
    """The input's columns without text, plus lang_pred, score, bits_per_symbol, rejected; one row per input row.

    ``und`` with score 0 where the text is null or empty or has no letter, or no
    model could be fitted. ``rejected`` says that even the best language's
    cross-entropy lies above what its calibration documents showed; the language
    is named all the same. Languages with equal cross-entropy: the lesser name.
    Repeated rows are judged alike, very long texts as a whole. Input columns with
    the names of outputs are replaced.
    """
    own = docs.drop(*OUTPUTS)
    own = own.withColumn("text", F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    return own.mapInArrow(_score(model), f"{fields}, lang_pred string, score double, bits_per_symbol double, rejected boolean".removeprefix(", "))
