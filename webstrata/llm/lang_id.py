"""Language identification in two steps: family first, then one-versus-one linear SVMs inside it.

Features are counts of byte trigrams of the lower-cased text, hashed into
`n_features` bins, square-rooted and scaled to length one. A one-versus-rest linear
SVM over families picks the family; inside it, each pair of languages has its own
linear SVM, and most votes win (ties: the larger sum of margins).

The classifier is fitted on `per_language` rows of each label, those with the least
hashes of key and text among all labelled rows; everything else covers all rows and
whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; with
no labelled row all are `und`; with one language it is predicted with score 1;
labels outside the family table are families of their own. Other columns stay; the
two added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from webstrata.llm._text import LOWER, column, flat, slices

# The language family of each language code.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic",
}
N_FEATURES = 4096
#: What the driver may hold: a few hundred rows of each label.
MOST_LABELS = 1000
RANKED = 64


def features(raw: bytes | np.ndarray, n_features: int = N_FEATURES) -> np.ndarray:
    """One text's vector."""
    data = LOWER[np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw]
    out = np.zeros(n_features, np.float64)
    for at in range(0, len(data), 1 << 20):
        b = data[at : at + (1 << 20) + 2].astype(np.uint32)
        b[(b < 97) | ((b > 122) & (b < 128))] = 32
        if len(b) >= 3:
            gram = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
            out += np.bincount(gram >> np.uint32(32 - n_features.bit_length() + 1), minlength=n_features)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient steps; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    reg = 1.0 / (c * len(y))
    rate = 1.0 / (2 * 2 * weight.max() + reg)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y / len(y)
        nw, nb = vw + rate * (2 * (slack @ x) - reg * vw), vb + rate * 2 * slack.sum()
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w.astype(np.float32), float(b)


@dataclass
class Model:
    """Weights only; about n_features * (families + pairs of languages) numbers."""

    n_features: int
    families: list[str]
    family_w: np.ndarray
    family_b: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[str, tuple[np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from 0 to 1 of rows of features."""
        n = len(x)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        margin = x @ self.family_w.T + self.family_b
        best = margin.argmax(1) if len(self.families) > 1 else np.zeros(n, int)
        score = 1 / (1 + np.exp(-4 * margin[np.arange(n), best])) if len(self.families) > 1 else np.ones(n)
        out = np.empty(n, object)
        for k, family in enumerate(self.families):
            rows, names = np.flatnonzero(best == k), self.members[family]
            if not len(rows):
                continue
            if len(names) == 1:
                out[rows] = names[0]
                continue
            w, b = self.pairs[family]
            m = x[rows] @ w.T + b
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for col, (i, j) in enumerate((i, j) for i in range(len(names)) for j in range(i + 1, len(names))):
                votes[:, i] += m[:, col] > 0
                votes[:, j] += m[:, col] <= 0
                sums[:, i] += m[:, col]
                sums[:, j] -= m[:, col]
            win = (votes + np.tanh(sums / len(names)) * 0.49).argmax(1)
            out[rows] = np.array(names, object)[win]
            score[rows] = np.minimum(score[rows], 1 / (1 + np.exp(-4 * sums[np.arange(len(rows)), win] / (len(names) - 1))))
        return list(out), score


def fit(x: np.ndarray, labels: list[str], families: dict[str, str] | None = None) -> Model:
    known = families or FAMILIES
    names = np.array(labels, object)
    fam = np.array([known.get(n, n) for n in labels], object)
    all_fam = sorted(set(fam))
    members = {f: sorted(set(names[fam == f])) for f in all_fam}
    n = x.shape[1] if x.ndim == 2 else N_FEATURES
    fw, fb = np.zeros((len(all_fam), n), np.float32), np.zeros(len(all_fam), np.float32)
    if len(all_fam) > 1:
        for k, f in enumerate(all_fam):
            fw[k], fb[k] = _svm(x, np.where(fam == f, 1.0, -1.0))
    pairs = {}
    for f, ms in members.items():
        found = [_svm(x[(names == a) | (names == b)], np.where(names[(names == a) | (names == b)] == a, 1.0, -1.0)) for i, a in enumerate(ms) for b in ms[i + 1 :]]
        if found:
            pairs[f] = np.stack([w for w, _ in found]), np.array([b for _, b in found], np.float32)
    return Model(n, all_fam, fw, fb, members, pairs)


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, families: dict[str, str] | None = None) -> Model:
    """Fits on the per_language rows of each label (documented bound) with the least hashes of key and text; MOST_LABELS labels at most."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"))
    rows = rows.where("lang is not null and text is not null")
    least = Window.partitionBy("lang").orderBy("h")
    # ranked in RANKED buckets of each label first, so that one task gets RANKED * per_language rows at most, at any size
    some = rows.select("lang", "h", F.pmod(F.xxhash64("h"), F.lit(RANKED)).alias("bucket"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("h"))).where(F.col("r") <= per_language)
    ranked = some.withColumn("r", F.row_number().over(least)).where(F.col("r") <= per_language)
    upto = ranked.groupBy("lang").agg(F.max("h").alias("upto")).limit(MOST_LABELS + 1).toArrow()
    if upto.num_rows > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not upto.num_rows:
        return Model(N_FEATURES, [], np.zeros((0, N_FEATURES)), np.zeros(0), {}, {})
    upto = F.broadcast(labelled.sparkSession.createDataFrame(upto))
    # rows that are equal in key and text have one hash, so the ranks are taken again
    chosen = rows.join(upto, "lang").where("h <= upto").withColumn("r", F.row_number().over(least)).where(F.col("r") <= per_language).select("text", "lang", "h")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = flat(column(part, "text"))
                vs = [features(data[a:b]).astype(np.float16).tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "h"), column(part, "lang"), pa.array(vs, pa.binary())], ["h", "lang", "v"])

    got = sorted((tuple(r) for r in chosen.mapInArrow(vectors, "h long, lang string, v binary").collect()), key=lambda r: (r[1], r[0]))
    if not got:
        return Model(N_FEATURES, [], np.zeros((0, N_FEATURES)), np.zeros(0), {}, {})
    return fit(np.stack([np.frombuffer(v, np.float16).astype(np.float32) for _, _, v in got]), [x for _, x, _ in got], families)


def identify(docs: DataFrame, model: Model, *, text: str = "text", pred: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """The rows with the predicted language and its score; one pass, no shuffle."""
    keep = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    if text not in keep:
        raise ValueError("the text column clashes with an output column")
    out = [c for c in keep if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in out] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, text):
                texts = column(part, text)
                data, offs = flat(texts)
                x = np.stack([features(data[a:b], m.n_features) for a, b in zip(offs[:-1], offs[1:], strict=True)])
                langs, sure = m.predict(x)
                none = ~np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                langs = pa.array(np.where(none, "und", np.array(langs, object)), pa.string())
                sure = pa.array(np.where(none, 0.0, np.clip(sure, 0, 1)), pa.float64())
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in out), langs, sure], [*out, pred, score])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(predict, schema)
