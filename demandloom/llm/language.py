"""Language identification by multilingual mixture inference.

Character trigrams (letters lower-cased, anything else a space) are hashed
into 2**18 buckets; each language is a smoothed distribution over them. A
document is a mixture of languages: expectation-maximisation estimates the
proportions over all of them, then languages are added in order of their share as long as the
likelihood of the refitted mixture rises by more than a penalty of half a
logarithm of the number of trigrams for each language, weighted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.hashing import slices

BITS = 18
PIECE = 1 << 20  # characters handled at once
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageModel:
    """Languages in name order and their trigram probabilities, one column each; at most languages x 2**18 numbers."""

    names: tuple[str, ...]
    probabilities: np.ndarray
    known: int  # buckets seen in training


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_is_letter()[code], code, np.uint32(32))
    return _one_space(code)


def _one_space(code: np.ndarray) -> np.ndarray:
    keep = code != 32
    keep[1:] |= code[:-1] != 32
    keep[:1] = True
    return code[keep]


def _buckets(code: np.ndarray) -> np.ndarray:
    h = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of a whole text and how often each occurs; none if it has no letter."""
    text = text or ""
    total, carry = None, np.array([32], np.uint32)
    for at in range(0, max(len(text), 1), PIECE):
        code = _one_space(np.concatenate([carry, _codes(text[at : at + PIECE])]))
        last = at + PIECE >= len(text)
        if last and code[-1] != 32:
            code = np.append(code, np.uint32(32))
        if len(code) > 2:
            found = _buckets(code)
            if last and total is None:
                return np.unique(found, return_counts=True)
            more = np.bincount(found, minlength=1 << BITS)
            total = more if total is None else total + more
        carry = code[-2:]
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, table in tables.items():
            found = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(table[found])], ["lang", "bucket", "hits"])
        tables.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, hits = _counts(text)
            if len(found):
                if lang not in tables and len(tables) >= 24:  # bounds a task's memory
                    yield from flush()
                tables.setdefault(lang, np.zeros(1 << BITS, np.int64))[found] += hits
    yield from flush()


def fit_languages(labelled: DataFrame, smoothing: float = 0.1) -> LanguageModel:
    """Model of ``labelled`` (lang, text); rows with a null in either, or no letter, teach nothing."""
    rows = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    hits = rows.mapInArrow(_train, "lang string, bucket long, hits long").groupBy("lang", "bucket").agg(F.sum("hits").alias("hits")).toArrow()
    langs = hits.column("lang").to_pylist()
    names = tuple(sorted(set(langs)))
    counts = np.zeros((1 << BITS, len(names)))
    counts[hits.column("bucket").to_numpy(), np.array([names.index(x) for x in langs], int)] = hits.column("hits").to_numpy()
    known = int((counts.sum(1) > 0).sum())
    return LanguageModel(names, ((counts + smoothing) / (counts.sum(0) + smoothing * (1 << BITS))).astype(np.float64), known)


def _shares(p: np.ndarray, c: np.ndarray, starts: np.ndarray, doc: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents of a batch: proportions and log-likelihoods. Rows of ``p`` are in document order."""
    n = np.add.reduceat(c, starts)
    for _ in range(rounds):
        part = p * pi[doc]
        part *= (c / part.sum(1))[:, None]
        pi = np.add.reduceat(part, starts, axis=0) / n[:, None]
    return pi, np.add.reduceat(c * np.log((p * pi[doc]).sum(1)), starts)


def infer(model: LanguageModel, texts: list[str | None], penalty: float = 2.0, rounds: int = 8) -> list[tuple[str, float, dict[str, float], int, float]]:
    """For each text: language, its share, the shares of the selected set, trigrams, and the fit.

    The fit is the mean gain in log-likelihood of a trigram over a uniform guess among known ones.
    """
    out: list[tuple[str, float, dict[str, float], int, float]] = [(UNDETERMINED, 0.0, {}, 0, 0.0)] * len(texts)
    if not model.names:
        return out
    group: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        c = np.concatenate([x[2] for x in group]).astype(np.float64)
        sizes = np.array([len(x[1]) for x in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(group)), sizes)
        p = model.probabilities[np.concatenate([x[1] for x in group])]
        n, k = np.add.reduceat(c, starts), len(model.names)
        full, _ = _shares(p, c, starts, doc, np.full((len(group), k), 1 / k), rounds)
        order = np.argsort(-full, axis=1, kind="stable")
        best = np.zeros((len(group), k))
        best[np.arange(len(group)), order[:, 0]] = 1.0
        fit = np.add.reduceat(c * np.log(p[np.arange(len(p)), order[doc, 0]]), starts)
        open_ = np.arange(len(group))
        for size in range(2, k + 1):
            cost = penalty * 0.5 * np.log(n[open_] + 1)
            open_ = open_[full[open_, order[open_, size - 1]] * n[open_] > cost]  # fewer expected trigrams than the penalty cannot repay it
            if not len(open_):
                break
            start = np.zeros((len(open_), k))
            for j in range(size):
                start[np.arange(len(open_)), order[open_, j]] = np.maximum(full[open_, order[open_, j]], 1e-6)
            start /= start.sum(1, keepdims=True)
            rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in open_])
            at = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
            pi, ll = _shares(p[rows], c[rows], at, np.repeat(np.arange(len(open_)), sizes[open_]), start, rounds)
            gain = ll - fit[open_] > penalty * 0.5 * np.log(n[open_] + 1)
            won = open_[gain]
            best[won], fit[won] = pi[gain], ll[gain]
            open_ = won
        top = np.argmax(best, axis=1)
        for g, (i, _, _) in enumerate(group):
            shares = {model.names[j]: float(best[g, j]) for j in np.flatnonzero(best[g] > 0)}
            out[i] = (model.names[top[g]], min(1.0, float(best[g, top[g]])), shares, int(n[g]), float(fit[g] / n[g] + np.log(max(model.known, 1))))
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        found, hits = _counts(text)
        if len(found):
            group.append((i, found, hits))
            held += len(found)
        if held > 200_000:
            settle()
            held = 0
    if group:
        settle()
    return out


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (share of that language), lang_shares, n_grams and fit added.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned.
    Columns of these names in ``docs`` are replaced; a tie goes to the first language name.
    """
    added = {"lang_pred": pa.string(), "score": pa.float64(), "lang_shares": pa.map_(pa.string(), pa.float64()), "n_grams": pa.int64(), "fit": pa.float64()}
    docs = docs.drop(*added)
    kinds = (T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType()), T.LongType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(added, kinds, strict=True))])
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = infer(model, batch.column(at).to_pylist())
            columns = [[x[0] for x in found], [x[1] for x in found], [list(x[2].items()) for x in found], [x[3] for x in found], [x[4] for x in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(columns, added.values(), strict=True))], [*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
