"""Operator 3: language identification with string kernels.

A text (lower-cased, all but letters blanked) is the set of its byte n-grams
of 2 to 4 bytes, hashed to ``DIMS`` places (a blended-spectrum presence
kernel: shared n-grams over the root of the product of the set sizes). The
kernel matrix is approximated with Nystrom landmarks: of every language the
``landmarks`` / languages training texts whose id hashes lowest. One ridge
regression per language (one versus the rest, targets +-1) is solved on at
most about ``fit_rows`` training texts in the landmark space. Copies of a
training row (equal id and text) count once. All texts are
scored whole, by two matrix products per batch; the score is the softmax of
the regression values.

Edge cases: a text that is null or has no letter is ``und`` with score 0;
null languages are not trained on; more than ``landmarks`` / 2 languages are
an error, since each needs two landmarks; with no labelled text every text is
``und``; repeated rows give one result row each; a null id is predicted and
never trained on; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, whole_text

DIMS = 1 << 15
_BATCH = 64
# ASCII letters stay (lower case), the rest of ASCII becomes a blank
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters_of(text: str) -> bytes:
    """Lower-cased letters with blanks between; empty if there are none."""
    low = text.lower()
    raw = low.encode("utf-8", "replace").translate(_LETTERS)
    if not raw.strip():
        return b""
    if not low.isascii() and not any(c.isalpha() for c in low):
        return b""
    return raw


def ngram_places(raw: bytes) -> np.ndarray:
    """Places of the n-grams of 2 to 4 bytes (repeats included)."""
    data = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    out, code = [], data
    for n in (2, 3, 4):
        code = (code[:-1] << np.uint32(8)) | data[n - 1:]
        out.append((code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(17))
    return np.concatenate(out)


def presence(texts: list[bytes]) -> np.ndarray:
    """Unit rows of n-gram presence."""
    rows = np.zeros((len(texts), DIMS), np.float32)
    for k, raw in enumerate(texts):
        rows[k, ngram_places(raw)] = 1.0
    size = rows.sum(axis=1)
    rows /= np.sqrt(np.maximum(size, 1.0))[:, None]
    return rows


@dataclass
class KernelModel:
    """Landmark rows (landmarks x DIMS) and, per language, a weight of every
    landmark and a constant."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.landmarks.T @ self.weights + self.constants


def fit(kernel: np.ndarray, among: np.ndarray, labels: np.ndarray, langs: list[str],
        ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants of kernel ridge regression in the Nystrom space:
    ``kernel`` rows x landmarks, ``among`` landmarks x landmarks."""
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    space = kernel.astype(np.float64) @ root
    centre = space.mean(axis=0)
    space = space - centre
    targets = np.where(labels[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # each language weighs the same
    counts = np.array([(labels == lang).sum() for lang in langs])
    weight = (1.0 / counts)[np.searchsorted(langs, labels)]
    weight = weight / weight.sum() * len(labels)
    middle = (weight[:, None] * targets).sum(axis=0) / weight.sum()
    gram = space.T @ (space * weight[:, None])
    gram += ridge * np.trace(gram) / len(gram) * np.eye(len(gram))
    solved = np.linalg.solve(gram, space.T @ (weight[:, None] * (targets - middle)))
    return root @ solved, middle - centre @ solved


def _clean(texts: pa.Array) -> list[bytes]:
    return [letters_of(t) for t in texts.to_pylist()]


def _landmark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [np.unique(ngram_places(raw)).astype(np.int32) if raw else np.zeros(0, np.int32)
                  for raw in _clean(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("turn"), pa.array(places, pa.list_(pa.int32()))],
            names=["lang", "turn", "places"])


def _kernel_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = shared.value
        for batch in batches:
            clean = _clean(batch.column("text"))
            known = [k for k, raw in enumerate(clean) if raw]
            for lo in range(0, len(known), _BATCH):
                part = known[lo:lo + _BATCH]
                kernel = presence([clean[k] for k in part]) @ landmarks.T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(pa.array(part)),
                     batch.column("row").take(pa.array(part)),
                     pa.array(list(kernel), pa.list_(pa.float32()))],
                    names=["lang", "row", "kernel"])
    return rows


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: KernelModel | None = shared.value
        for batch in batches:
            clean = _clean(batch.column("text"))
            langs: list = ["und"] * len(clean)
            scores = np.zeros(len(clean))
            known = [k for k, raw in enumerate(clean) if raw and model is not None]
            for lo in range(0, len(known), _BATCH):
                part = known[lo:lo + _BATCH]
                values = model.scores(presence([clean[k] for k in part])).astype(np.float64)
                best = values.argmax(axis=1)
                odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                for k, b, s in zip(part, best, 1 / odds.sum(axis=1)):
                    langs[k] = model.langs[b]
                    scores[k] = s
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()),
                 pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])
    return predict


def train(rows: DataFrame, landmarks: int, fit_rows: int, ridge: float) -> KernelModel | None:
    """A model of training rows (doc_id, text, lang); None without any."""
    spark = rows.sparkSession
    row = F.xxhash64("doc_id", "text")
    # copies of a row (equal id and text) count once
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.approx_count_distinct(row).alias("n")).limit(landmarks // 2 + 1).collect()}
    if not counts:
        return None
    if len(counts) > landmarks // 2:
        raise ValueError(f"more than {landmarks // 2} languages: two landmarks each need "
                         f"landmarks > {landmarks}")
    langs = sorted(counts)
    turn = F.pmod(row, F.lit(1 << 30)).alias("turn")

    def sample(per_lang: int, spare: float) -> DataFrame:
        share = [F.when(F.col("lang") == lang, F.lit(int(min(1.0, spare * per_lang / n) * (1 << 30))))
                 for lang, n in counts.items()]
        return (rows.select("lang", "text", turn, row.alias("row"))
                .filter(F.col("turn") < F.coalesce(*share)).dropDuplicates(["lang", "row"]))

    each = landmarks // len(langs)
    # three times as many as needed, by chance; the lowest turns are taken
    found = sample(each, 3.0).mapInArrow(
        _landmark_rows, "lang string, turn bigint, places array<int>").collect()
    picked = []
    for lang in langs:
        own = sorted((r for r in found if r["lang"] == lang and r["places"]),
                     key=lambda r: (r["turn"], len(r["places"])))
        picked += own[:each]
    if not picked:
        return None
    matrix = np.zeros((len(picked), DIMS), np.float32)
    for k, r in enumerate(picked):
        matrix[k, r["places"]] = 1 / np.sqrt(len(r["places"]))
    shared = spark.sparkContext.broadcast(matrix)
    got = sample(max(each, fit_rows // len(langs)), 1.0).mapInArrow(
        _kernel_rows(shared), "lang string, row bigint, kernel array<float>").toPandas()
    got = got.sort_values(["lang", "row"])  # sums in one order, however rows arrive
    kernel = np.stack(got["kernel"].to_numpy())
    labels = got["lang"].to_numpy().astype(str)
    langs = sorted(set(labels))
    weights, constants = fit(kernel, matrix @ matrix.T, labels, langs, ridge)
    return KernelModel(langs, matrix, weights.astype(np.float32), constants.astype(np.float32))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", held_out_mod: int = 4, held_out: int = 2,
                       landmarks: int = 96, fit_rows: int = 4000,
                       ridge: float = 1e-3) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Trained on rows with a
    language whose id's crc32 modulo ``held_out_mod`` is not ``held_out``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"),
                       (crc_mod(F.col(id_col), held_out_mod) == held_out).alias("held_out"))
    model = train(rows.filter(F.col("lang").isNotNull() & ~F.col("held_out")),
                  landmarks, fit_rows, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"),
                       "text").mapInArrow(
        _predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
