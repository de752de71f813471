"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

A text's vector counts hashed byte trigrams of its lower-cased words; counts are
damped, weighted by inverse document frequency and normalised. Each language
has several centroids, found by spherical k-means. A text gets the language of
the centroid with the greatest cosine; it is rejected where even that lies nearer
to what texts of other languages reach there than to what the language's own texts do.
The training texts and crops of them show both, by length: short texts reach less.

Document frequencies come from every training text, in one distributed pass
that returns one number per feature. Centroids are fitted on about ``fit_docs``
whole texts per language, fewer where ``FIT_TEXTS`` in all would be passed but at
least about ``LEAST_TEXTS`` (all of a language that has no more), drawn by hashed ids;
the bounds do not depend on the input's size. Every language is learned, however many
there are. Scoring is one pass over all documents where they lie; the model that
tasks get takes languages x clusters x features, 48 KB a language.

``und`` stands for null texts and texts without a letter. Null languages and
null ids do not train. Training data without any language leaves every text ``und``.
Rows that repeat an id are drawn together for training and predicted each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import LOWER, byte_class, slices, small_batches, text_buffers

FEATURES = 4096
CLUSTERS = 3
#: Training texts per language for the centroids.
FIT_DOCS = 400
#: Training texts of all languages together; beyond it, each language gets an equal share, but not below LEAST_TEXTS.
FIT_TEXTS = 40_000
LEAST_TEXTS = 16
#: The cosine that all but this share of a language's own texts exceed, and the one that this share of other languages' stay below.
OWN_LOW, OTHER_HIGH = 0.01, 0.95
#: Characters of the crops of training texts.
CROPS = (10, 25, 60, 150)
#: Floors are set by the number of distinct features: below 8, 16, ... and from the last on.
LENGTHS = np.array([8, 16, 32, 64, 128, 256])
#: Own texts that a length needs for a floor of its own.
LEAST = 10
UNKNOWN = "und"
#: Values of a hashed id's draw.
DRAWS = 1 << 30
#: Rows of counts held at once.
BLOCK = 128

IS_LETTER_BYTE = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
IS_ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows' feature counts: (first row, float32 matrix). Trigrams span a word and the blanks at its ends."""
    rows = len(offsets) - 1
    plain = np.where(IS_LETTER_BYTE[data], LOWER[data], np.uint8(32))
    # a blank before and after each row keeps trigrams within rows
    text = np.full(len(data) + 2 * rows, 32, dtype=np.uint8)
    shift = 2 * np.repeat(np.arange(rows), np.diff(offsets)) + 1
    text[np.arange(len(data)) + shift] = plain
    edges = offsets + 2 * np.arange(rows + 1)
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    keep[edges[:-1]] = True
    text = text[keep]
    edges = np.concatenate([[0], np.cumsum(keep)])[edges]
    if len(text) < 3:
        for at in range(0, rows, BLOCK):
            yield at, np.zeros((min(BLOCK, rows - at), FEATURES), dtype=np.float32)
        return
    a = text.astype(np.uint32)
    gram = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    feature = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int64)
    feature[a[1:-1] == 32] = -1  # two words' ends
    starts = np.minimum(edges[:-1], len(feature))
    stops = np.clip(edges[1:] - 2, starts, len(feature))
    for at in range(0, rows, BLOCK):
        n = min(BLOCK, rows - at)
        span = feature[starts[at] : stops[at + n - 1]]
        size = np.diff(np.append(starts[at : at + n], stops[at + n - 1])) if n else np.zeros(0, int)
        row = np.repeat(np.arange(n), size)
        cut = np.arange(len(span)) + starts[at]
        ok = (span >= 0) & (cut < stops[at : at + n][row])
        yield at, np.bincount(row[ok] * FEATURES + span[ok], minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of damped counts times idf; a row without features stays zero."""
    v = np.log1p(counts, out=counts)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.where(norm > 0, norm, 1)[:, None]
    return v


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    cum = np.concatenate([[0], np.cumsum(IS_ASCII_LETTER[data])])
    out = cum[offsets[1:]] > cum[offsets[:-1]]
    for r in np.flatnonzero(~out).tolist():
        raw = data[offsets[r] : offsets[r + 1]]
        if (raw & 0x80).any():
            out[r] = any(c.isalpha() for c in raw.tobytes().decode("utf-8"))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES), np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    floor: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LENGTHS) + 1), np.float32))  # by language and length

    def floors(self, own: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The cosine below which a text of so many distinct features is rejected by its language."""
        return self.floor[own, np.searchsorted(LENGTHS, features, side="right")]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and cosine of the nearest centroid; ties go to the earlier language."""
        cos = vectors @ self.centroids.T
        best = cos.argmax(axis=1)
        return self.owner[best], np.clip(cos[np.arange(len(cos)), best], 0, 1)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are chosen farthest-first from the vector nearest the mean, so no seed is needed."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen].copy()
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                m = vectors[own == c].mean(axis=0)
                centers[c] = m / max(float(np.linalg.norm(m)), 1e-12)
    return centers


def training_rows(id_col: Column) -> Column:
    """Rows that may train: crc32 of the id's text is not 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(FEATURES, dtype=np.int64), 0
    for rows, data, offsets in slices(batches, "text"):
        for _, counts in trigram_counts(data, offsets):
            df += (counts > 0).sum(axis=0)
        docs += rows.num_rows
    df = np.append(df, docs)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["feature", "n"])


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text"):
        langs, texts = rows.column(0), rows.column(1).to_pylist()
        crops = [t[(len(t) - n) // 2 :][:n] for t in texts for n in CROPS if len(t) > n]
        owner = [i for i, t in enumerate(texts) for n in CROPS if len(t) > n]
        for crop, owners, buffers in ((False, langs, (data, offsets)), (True, langs.take(pa.array(owner, pa.int64())), text_buffers(pa.array(crops, pa.string())))):
            packed = [c.astype(np.float32).tobytes() for _, counts in trigram_counts(*buffers) for c in _sparse(counts)]
            yield pa.RecordBatch.from_arrays([owners, pa.array([crop] * len(packed), pa.bool_()), pa.array(packed, pa.binary())], ["lang", "crop", "counts"])


def _sparse(counts: np.ndarray) -> Iterator[np.ndarray]:
    for row in counts:
        at = np.flatnonzero(row)
        yield np.concatenate([at, row[at]])


def _dense(sparse: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sparse), FEATURES), dtype=np.float32)
    for row, x in zip(out, sparse, strict=True):
        row[x[: len(x) // 2].astype(np.int64)] = x[len(x) // 2 :]
    return out


def _fit_floors(model: LanguageModel, by_lang: dict[str, list[np.ndarray]]) -> np.ndarray:
    """Floors by language and length, between the cosines of its own texts and those of the languages left out of it.

    To a language's centroids every other language is one that they have not learned. Rolled
    counts, which keep a text's length but no trigram, stand for gibberish, also where only one
    language is known. Where own and other texts overlap, the own texts stay.
    """
    n = len(model.languages)
    low, high = np.full((n, len(LENGTHS) + 1), np.nan), np.zeros((n, len(LENGTHS) + 1))
    starts = np.searchsorted(model.owner, np.arange(n))
    for own, lang in enumerate(model.languages):
        for at in range(0, len(by_lang[lang]), 2048):
            counts = _dense(by_lang[lang][at : at + 2048])
            length = np.searchsorted(LENGTHS, (counts > 0).sum(axis=1), side="right")
            some = counts.any(axis=1)
            for gibberish in (True, False):
                vectors = weighted(np.roll(counts, FEATURES // 2, axis=1) if gibberish else counts, model.idf)
                cos = np.maximum.reduceat(vectors @ model.centroids.T, starts, axis=1)
                for c in np.unique(length[some]):
                    x = cos[some & (length == c)]
                    others = np.quantile(x, OTHER_HIGH, axis=0)
                    if not gibberish:
                        others[own] = 0
                        if len(x) >= LEAST:
                            low[own, c] = np.fmin(low[own, c], np.quantile(x[:, own], OWN_LOW))
                    high[:, c] = np.maximum(high[:, c], others)
    out = np.where(high < low, np.sqrt(low * high), low)
    for row in out:
        known = np.flatnonzero(~np.isnan(row))
        if len(known):
            # a length without own texts takes the floor of the next shorter one that has them, the lower one
            row[:] = row[known[np.maximum(np.searchsorted(known, np.arange(len(row)), side="right") - 1, 0)]]
            row[: known[0]] = 0
    return np.nan_to_num(out, nan=0.0).astype(np.float32)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, clusters: int = CLUSTERS) -> LanguageModel:
    """Learns from the training rows of ``docs`` that have a language."""
    small_batches(docs.sparkSession)
    train = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(training_rows(F.col("id")) & F.col("lang").isNotNull())
    df = {r["feature"]: r["n"] for r in train.select("text").mapInArrow(_document_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(FEATURES, 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(FEATURES)]))).astype(np.float32)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(DRAWS))
    texts = train.where(F.length("text") > 0).withColumn("draw", draw)
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not sizes:
        return LanguageModel([], idf)
    # each text's hashed id draws for it, so that about fit_docs of each language, and one at least, are taken
    each = max(min(fit_docs, FIT_TEXTS / len(sizes)), min(fit_docs, LEAST_TEXTS))
    limits = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], int(min(each / r["n"], 1) * DRAWS))) for r in sizes], "lang string, most long")
    sample = texts.join(limits, "lang").where("draw <= most").select("lang", "text").mapInArrow(_sample_vectors, "lang string, crop boolean, counts binary")
    by_lang: dict[str, list[np.ndarray]] = {}
    crops: dict[str, list[np.ndarray]] = {}
    for r in sample.collect():
        (crops if r["crop"] else by_lang).setdefault(r["lang"], []).append(np.frombuffer(r["counts"], dtype=np.float32))
    model = LanguageModel(sorted(by_lang), idf)
    centers = []
    for lang in model.languages:
        vectors = weighted(_dense(by_lang[lang]), idf)
        vectors = vectors[np.lexsort(vectors.T[:8])]  # the order of rows must not matter
        centers.append(spherical_kmeans(vectors, clusters))
    if centers:
        model.centroids = np.concatenate(centers).astype(np.float32)
        model.owner = np.repeat(np.arange(len(centers)), [len(c) for c in centers])
        model.floor = _fit_floors(model, {lang: by_lang[lang] + crops.get(lang, []) for lang in model.languages})
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine), rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, UNKNOWN], pa.string())
        for rows, data, offsets in slices(batches, "text"):
            n = rows.num_rows
            lang, score, floor = np.full(n, len(m.languages)), np.zeros(n), np.full(n, np.inf)
            if len(m.centroids):
                for at, counts in trigram_counts(data, offsets):
                    features = (counts > 0).sum(axis=1)
                    own, cos = m.nearest(weighted(counts, m.idf))
                    lang[at : at + len(own)], score[at : at + len(own)], floor[at : at + len(own)] = own, cos, m.floors(own, features)
                letters = has_letter(data, offsets)
                lang[~letters], score[~letters], floor[~letters] = len(m.languages), 0.0, np.inf
            yield pa.RecordBatch.from_arrays([rows.column(0), names.take(pa.array(lang)), pa.array(score, pa.float64()), pa.array(score < floor)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without rows whose language is unknown or rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, offsets in slices(batches, text_col):
            ok = np.zeros(rows.num_rows, dtype=bool)
            if len(m.centroids):
                for at, counts in trigram_counts(data, offsets):
                    features = (counts > 0).sum(axis=1)
                    own, cos = m.nearest(weighted(counts, m.idf))
                    ok[at : at + len(own)] = cos >= m.floors(own, features)
                ok &= has_letter(data, offsets)
            yield rows.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_languages(docs, fit_languages(docs))
    return found.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
