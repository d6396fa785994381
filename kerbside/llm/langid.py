"""Language identification as mixture inference.

Each language is a distribution over hashed letter trigrams, learned from a bounded sample of labelled rows. For
a document, expectation-maximisation estimates the proportions of the languages from the likelihoods of all its
trigrams; the set of languages is the one of best penalised likelihood, a language being added only if it pays
for its parameter. The prediction is the language of the largest proportion, which is the score.

Defined cases: ``und`` with score 0 for a null text, one without a letter, and where nothing could be learned;
ties go to the language that sorts first; rows with null lang or null doc_id teach nothing but are predicted;
each input row gives one row, repeated ones too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_arrow, slices, whole_rows

#: About so many labelled rows of each language are learned from, chosen by a hash of their ids.
LABELLED_PER_LANGUAGE = 2000
GRAMS = 1 << 16
ROUNDS = 8
#: What a further language must add to the log-likelihood, per logarithm of the trigrams.
PENALTY = 2.0
SMOOTH = 0.05


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed trigrams of all texts one after another; where each text's begin and end; has it a letter?

    Letters are lower-cased; any run of other characters, and the sides of a text, are one space.
    """
    joined = "  ".join((x or "").lower() for x in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    length = np.fromiter((len((x or "").lower()) + 2 for x in texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(length)])
    # one space before and after each text, which the two of the separator become
    code = np.concatenate([[32], np.where(letter, code, 32), [32]]).astype(np.uint32)
    letter = np.concatenate([[False], letter, [False]])
    keep = letter | np.concatenate([[True], letter[:-1]])
    own = code[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    from_, to = place[start[:-1]], place[np.minimum(start[1:], len(keep))]
    some = np.array([bool(letter[a + 1 : b].any()) for a, b in zip(start, start[1:])])
    if len(own) < 3:
        return np.zeros(0, np.uint16), np.zeros((len(texts), 2), np.int64), some
    h = own[:-2] * np.uint32(0x9E3779B1) ^ own[1:-1] * np.uint32(0x85EBCA6B) ^ own[2:] * np.uint32(0xC2B2AE35)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    bounds = np.stack([np.maximum(from_ - 1, 0), np.minimum(to - 2, len(h))], 1)
    return h.astype(np.uint16), np.maximum(bounds, bounds[:, :1]), some


def learn(docs: DataFrame, per_language: int = LABELLED_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithm of each trigram's share in them, by trigram and language."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null")
    # one row for each language
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((GRAMS, 0))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / counts[k]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            h, bounds, _ = grams(batch.column("text").to_pylist())
            for lang, (a, b) in zip(batch.column("lang").to_pylist(), bounds):
                held.setdefault(lang, np.zeros(GRAMS, np.int64))
                np.add.at(held[lang], h[a:b], 1)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "gram", "n"]
            )

    seen = sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = np.full((GRAMS, len(names)), SMOOTH)
    for r in seen.toLocalIterator():  # at most GRAMS rows a language
        table[r["gram"], names.index(r["lang"])] += r["n"]
    return names, np.log(table / table.sum(0))


def _proportions(p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation-maximisation from ``start``; the log-likelihood of what it ends with."""
    pi, total = start, n.sum()
    for _ in range(rounds):
        pi = pi * ((n / (p @ pi)) @ p) / total
    return pi, float(n @ np.log(p @ pi))


def mixture(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The proportions of all languages in a document of these trigrams; 0 outside the chosen set."""
    h = np.sort(h, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(edge, len(h))).astype(float)
    log = table[h[edge]]
    alone = n @ log
    top = int(np.argmax(alone))
    out = np.zeros(table.shape[1])
    # likelihoods relative to the largest of each trigram; the shift is the same for every set
    shift = log.max(1)
    p = np.exp(log - shift[:, None])
    best, chosen = alone[top] - n @ shift, [top]
    out[top] = 1
    if table.shape[1] == 1:
        return out
    full, _ = _proportions(p, n, np.full(table.shape[1], 1 / table.shape[1]), ROUNDS)
    cost = PENALTY * np.log(n.sum() + 1)
    for k in sorted((k for k in range(len(full)) if k != top), key=lambda k: -full[k]):
        wider = [*chosen, k]
        start = np.maximum(full[wider], 1e-3)
        pi, likely = _proportions(p[:, wider], n, start / start.sum(), ROUNDS)
        if likely - best <= cost:
            break
        best, chosen = likely, wider
        out[:] = 0
        out[wider] = pi
    return out


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, also: str | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, and the column ``also`` of any type."""
    model = docs.sparkSession.sparkContext.broadcast(table)
    own = ["doc_id", "text"] + ([also] if also else [])

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, bounds, some = grams(batch.column("text").to_pylist())
        names, scores = [], []
        for (a, b), letters in zip(bounds, some):
            if not letters or not languages:
                names.append("und")
                scores.append(0.0)
            else:
                pi = mixture(h[a:b], model.value)
                top = int(np.argmax(pi))
                names.append(languages[top])
                scores.append(min(1.0, float(pi[top])))
        kept = [batch.column(c) for c in own if c != "text"]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(c for c in own if c != "text"), "lang_pred", "score"]
        )

    types = f", `{also}` {docs.schema[also].dataType.simpleString()}" if also else ""
    return map_arrow(docs.select(*own), "text", f"doc_id long{types}, lang_pred string, score double", predict)


def with_language(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """The documents that have a language, with their own columns; ``lang`` becomes the prediction.

    Null texts and texts without a letter go. Repeated rows and null ids stay; a column may have any name."""
    rows = whole_rows(docs, doc_id="doc_id", text="text")
    found = identify(rows, languages, table, "row").where("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
