"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng: random.Random, n: int, syllables: str = "ba be bi do du ka ke lo mi na no ra ri se ta to") -> str:
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    base = words(rng, 300)
    cut = base.split()
    edited = [" ".join([*cut[:k], "changed", *cut[k + 1 :]]) for k in (10, 120, 250)]
    shared = words(rng, 60)
    texts: list[str | None] = [base, base, *edited, None, "", "  \n\t ", "one", "one two three four", "ONE two three four", words(rng, 20_000)]
    texts += [f"{words(rng, 40)} {shared} {words(rng, 40)}" for _ in range(5)]
    texts += ["na " * 500, "é" * 150, "日本語 " * 80, "x" * 199, "x" * 200, "\U0001f600" * 60]
    return texts


def documents(spark, texts=None, langs=("en", "de")):
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, langs[i % len(langs)], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df, *names):
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
