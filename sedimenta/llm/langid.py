"""Language identification: normalised TF-IDF n-gram vectors against several centroids per language, by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, crc_mod, id_text, in_slices, quoted

DIMENSIONS = 4096
N_GRAMS = (1, 2, 3)
#: Bounds of what the centroids are fitted on: documents drawn for each language, in the mean, and languages.
SAMPLE = 400
MAX_LANGUAGES = 1000
CENTROIDS = 3
#: Share of the sample beyond a centroid's distance limit: farther texts are rejected.
REJECT_SHARE = 0.005
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def _classes() -> np.ndarray:
    """Code point to itself where it is a letter, else to a space; above 0x3000 all count as letters."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], np.uint32)


_TABLE = _classes()


def n_gram_counts(text: str) -> np.ndarray:
    """Hashed counts of letter n-grams of a lower-cased text; runs of other characters are one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 0x3000
    points = np.where(low, _TABLE[np.where(low, points, 32)], points)
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    x = points[keep].astype(np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    with np.errstate(over="ignore"):
        code = np.zeros(len(x), np.uint32)
        for n in range(1, max(N_GRAMS) + 1):
            if len(x) < n:
                break
            code = code[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
            if n in N_GRAMS:
                h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(20), minlength=DIMENSIONS)
    return counts


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(learn: DataFrame) -> tuple[int, np.ndarray]:
    """How many learning documents there are, and in how many each dimension occurs: over all of them."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen += n_gram_counts(text) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield batch_of(schema, [[*at.tolist(), -1], [*seen[at].tolist(), n]])

    rows = learn.select("doc_id", "text").mapInArrow(run, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    found = {r.dim: r.n for r in rows}
    return found.get(-1, 0), np.array([found.get(d, 0) for d in range(DIMENSIONS)])


def _sample(learn: DataFrame, size: int) -> DataFrame:
    """(lang, text) of about `size` documents of each language, all where there are fewer: those whose hash of id and
    text is below the language's share. A repeated row counts once. More than MAX_LANGUAGES languages are an error."""
    keyed = learn.withColumn("h", F.xxhash64("doc_id", "text"))
    found = keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    shares = learn.sparkSession.createDataFrame([(r.lang, 1.0 if r.n <= 1.2 * size else size / r.n) for r in found], "lang string, share double")
    drawn = keyed.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 11) < F.col("share") * F.lit(float(1 << 53)))
    return drawn.dropDuplicates(["lang", "h"]).select("lang", "text")


def _cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; the next first centroid is the vector farthest from those there are."""
    centroids = [x.mean(0)]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[np.max(x @ np.array(centroids).T, axis=1).argmin()])
    c = np.array(centroids)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(learn: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """A model from learn(doc_id, text, lang): document frequencies of all rows, centroids of a bounded sample."""
    learn = learn.where(F.col("lang").isNotNull())
    n, df = document_frequencies(learn)
    if not n:
        return {"idf": np.ones(DIMENSIONS, np.float32), "langs": [], "centroids": np.zeros((0, DIMENSIONS), np.float32), "limits": np.zeros(0)}
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    schema = pa.schema([("lang", pa.string()), ("centroid", pa.binary()), ("limit", pa.float64())])

    def one(group: pa.Table) -> pa.Table:
        # sorted, so that the centroids don't hang on the order of rows
        x = _vectors(np.array(sorted(map(tuple, (n_gram_counts(t) for t in group["text"].to_pylist())))), idf)
        c = _cluster(x, k)
        best = x @ c.T
        near = [best[best.argmax(1) == i, i] for i in range(len(c))]
        limits = [float(np.quantile(n, REJECT_SHARE)) if len(n) else 0.0 for n in near]
        return pa.Table.from_batches([batch_of(schema, [[group["lang"][0].as_py()] * len(c), [v.astype("<f4").tobytes() for v in c], limits])])

    rows = _sample(learn, sample).groupBy("lang").applyInArrow(lambda group: one(group), "lang string, centroid binary, limit double").collect()  # k vectors a language
    rows.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    return {"idf": idf, "langs": [r.lang for r in rows], "centroids": np.array([np.frombuffer(r.centroid, "<f4") for r in rows]), "limits": np.array([r["limit"] for r in rows])}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred (the nearest centroid's language, "und" for a null text or one without letters), score (its
    cosine, 0 to 1; 0 for "und") and rejected (farther than the centroid's limit), for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in in_slices(batch, 1 << 20):
                texts = part.column(1).to_pylist()
                lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                at = [i for i, t in enumerate(texts) if m["langs"] and _letter.search(t)]
                for start in range(0, len(at), 256):
                    some = at[start : start + 256]
                    cos = _vectors(np.array([n_gram_counts(texts[i]) for i in some]), m["idf"]) @ m["centroids"].T
                    for i, best, value in zip(some, cos.argmax(1).tolist(), cos.max(1).tolist()):
                        lang[i], score[i], rejected[i] = m["langs"][best], min(1.0, max(0.0, value)), value < m["limits"][best]
                yield batch_of(schema, [part.column(0), lang, score, rejected])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows whose crc32(id) modulo folds is not held_fold and predict all: predict's columns and held_out."""
    held: Column = crc_mod("doc_id", folds) == held_fold
    learn = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"), F.col(quoted(lang_col)).alias("lang")).where(~held)
    return predict(docs, fit(learn), id_col, text_col).withColumn("held_out", held)
