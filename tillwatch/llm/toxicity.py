"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are pieces between white space, by their letters in lower case. The field has two tags, toxic or not. Labels are of
documents, so tokens to learn from are labelled first: a word or word start is a cue if labelled documents that have it are
toxic much more often than the rest (a likelihood ratio), and in toxic documents the tokens with a cue are toxic; in clean
documents none is. Forward-backward gives each token's marginal. A document's score is a logistic regression on the sum
and the maximum of its marginals (the sum without slight ones), fitted on labelled documents that the field was not trained on.

The fit takes a bounded sample of labelled documents (``sample`` of each class, texts up to ``longest`` characters); every
text is scored whole, in memory bounded by a batch of rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm import crf
from tillwatch.llm.memory import small_batches, tidied, trim

SAMPLE = 1200
LONGEST = 20_000
FEATURES = 1 << 18
CACHED = 500_000
BATCH_TOKENS = 300_000
LEAST_P = 0.2
CUE_RATIO = 9.0  # nats of likelihood ratio that make a cue
LETTERS = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"\S+")

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])))])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A document without id is not trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def word_of(piece: str) -> str:
    return "".join(LETTERS.findall(piece))


def cues_of(word: str) -> list[str]:
    """The word, and its starts of 4 to 7 letters."""
    return [f"={word}", *(word[:n] for n in range(4, min(7, len(word)) + 1))] if word else []


def features_of(word: str) -> list[int]:
    """Hashed features: a bias, cues and the ending."""
    names = [*cues_of(word), f"-{word[-3:]}"]
    return [0, *(1 + zlib.crc32(x.encode()) % (FEATURES - 1) for x in names)]


def cues(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Words and word starts whose documents are toxic significantly more often than others."""
    share = sum(toxic) / max(len(toxic), 1)
    if not 0 < share < 1:
        return set()
    of, total = Counter(), Counter()
    for words, label in zip(texts, toxic, strict=True):
        found = {c for w in set(words) for c in cues_of(w)}
        total.update(found)
        if label:
            of.update(found)
    out = set()
    for cue, hits in of.items():
        n = total[cue]
        rate = hits / n
        ratio = hits * math.log(rate / share) + ((n - hits) * math.log((1 - rate) / (1 - share)) if hits < n else 0.0)
        if rate > 0.75 and ratio > CUE_RATIO:
            out.add(cue)
    return out


def flat(texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
    first = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    words = [w for t in texts for w in t]
    return words, np.unique(first[first < len(words)])


def summary(p: np.ndarray) -> list[float]:
    """What a document's score is made from: expected number of toxic tokens, the surest one, and whether there is any.

    Marginals under LEAST_P do not add up, so that a text is not toxic for being long.
    """
    top = min(max(float(p.max()), 1e-6), 1 - 1e-6) if len(p) else 1e-6
    p = p[p >= LEAST_P]
    none = float(np.log1p(-np.minimum(p, 1 - 1e-6)).sum())
    return [math.log1p(float(p.sum())), math.log(top / (1 - top)) / 10 + 1.4, 1 - math.exp(none)]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 2000, rate: float = 1.0, l2: float = 1e-4) -> np.ndarray:
    """Weights, the last one the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        w += rate * (x.T @ (y - 1 / (1 + np.exp(-(x @ w)))) / len(x) - l2 * np.append(w[:-1], 0))
    return w


def fit(rows: list[tuple[str, int, int]]) -> dict:
    """The model, of (text, toxic, part) rows: part 0 trains the field, part 1 the score. Without rows of both classes every score is the share of toxic rows."""
    once: dict[str, str] = {}  # equal words are one object
    texts = [[once.setdefault(w, w) for w in map(word_of, (text or "").lower().split())] for text, _, _ in rows]
    share = sum(y for _, y, _ in rows) / len(rows) if rows else 0.0
    model = {"between": np.zeros((2, 2)), "start": np.zeros(2), "w": np.zeros(FEATURES), "score": np.array([0.0, 0.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3))])}
    marked = cues(texts, [y for _, y, _ in rows])
    mine = [i for i, (_, _, part) in enumerate(rows) if part == 0]
    words, first = flat([texts[i] for i in mine])
    if not marked or not words:
        return model
    is_cue: dict[str, bool] = {w: any(c in marked for c in cues_of(w)) for w in set(words)}
    tags = np.array([int(rows[i][1] and is_cue[w]) for i in mine for w in texts[i]])
    if not tags.any():
        return model
    types = {w: k for k, w in enumerate(sorted(is_cue))}
    field = crf.train([features_of(w) for w in types] + [[]], np.array([types[w] for w in words]), tags, first, 2, FEATURES)
    model |= {"between": field["between"], "start": field["start"], "w": field["weights"][0][:, 1] - field["weights"][0][:, 0]}
    rest = [i for i, (_, _, part) in enumerate(rows) if part == 1] or mine
    seen: dict[str, float] = {}
    x = np.array([summary(p) for k in range(0, len(rest), 200) for p in document_marginals([texts[i] for i in rest[k : k + 200]], model, seen, word_of)])
    model["score"] = logistic(x, np.array([rows[i][1] for i in rest], dtype=float))
    return model


def document_marginals(texts: list[list[str]], model: dict, seen: dict[str, float], word) -> list[np.ndarray]:
    """For each document the probability that each of its tokens is toxic."""
    lengths = [len(t) for t in texts]
    out: list[float] = []
    for pieces in texts:
        for piece in pieces:
            score = seen.get(piece)
            if score is None:
                score = float(model["w"][features_of(word(piece))].sum())
                if len(piece) <= 64:
                    if len(seen) >= CACHED:
                        seen.clear()
                    seen[piece] = score
            out.append(score)
    scores = np.zeros((len(out), 2))
    scores[:, 1] = out
    first = np.cumsum([0, *lengths])[:-1]
    p = crf.marginals(scores, model["between"], model["start"], np.unique(first[first < len(out)]))[:, 1]
    return np.split(p, np.cumsum(lengths)[:-1]) if lengths else []


def score_of(model: dict, p: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-(np.append(summary(p), 1.0) @ model["score"]))))


def scored(texts: pd.Series, model: dict, seen: dict[str, float], threshold: float) -> Iterator[dict]:
    """Score and toxic spans of each text, some at a time."""
    waiting: list[str] = []
    pieces: list[list[str]] = []
    size = 0

    def flush() -> Iterator[dict]:
        for text, own, p in zip(waiting, pieces, document_marginals(pieces, model, seen, word_of), strict=True):
            score, spans = score_of(model, p), []
            hot = np.flatnonzero(p >= threshold)
            if len(hot):
                places = [m.span() for m in PIECE.finditer(text)]
                spans = [{"start": places[i][0], "end": places[i][1], "p": float(p[i])} for i in hot.tolist()]
            yield {"score": score, "spans": spans}

    for text in texts:
        waiting.append(text or "")
        pieces.append(waiting[-1].lower().split())
        size += len(pieces[-1])
        if size >= BATCH_TOKENS:
            yield from flush()
            waiting, pieces, size = [], [], 0
    yield from flush()


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, int, int]]:
    """Up to ``sample`` labelled texts of each class that are not held out, in the order of a hash of the id; a document with both labels is left out."""
    known = labels.select(F.col("doc_id").alias("id"), "toxic").filter("id is not null and toxic in (0, 1)").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    place = F.md5(F.col("id").cast("string"))
    chosen = [r for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy(place).limit(sample).collect()]
    if not chosen:
        return []
    picked = documents.sparkSession.createDataFrame([(int(r.id), int(r.toxic)) for r in chosen], "id bigint, toxic int")
    rows = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= longest)
    found = rows.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()  # the sample
    return [(r.text, r.toxic, zlib.crc32(f"part{r.id}".encode()) % 2) for r in sorted(found, key=lambda r: r.id)]


def with_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", out: str = "toxicity", threshold: float = 0.5, **options) -> DataFrame:
    """The documents with ``out``: struct(score from 0 to 1, spans: start and end in code points, and marginal, of toxic tokens).

    Null and empty texts get the score of a text without tokens. Only ids and labels of rows that are not held out are learnt
    from, and scores read nothing but the text. Other columns are kept; repeated rows are scored alike.
    """
    small_batches(documents.sparkSession)
    model = fit(training_rows(documents, labels, **options))
    trim()  # the driver does not keep what the fit has used
    shared = documents.sparkSession.sparkContext.broadcast({"model": model, "seen": {}})

    @F.pandas_udf(RESULT)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in tidied(texts):
            found = list(scored(batch, shared.value["model"], shared.value["seen"], threshold))
            yield pd.DataFrame({"score": [f["score"] for f in found], "spans": [f["spans"] for f in found]})

    return documents.withColumn(out, score(F.col(text).cast("string")))
