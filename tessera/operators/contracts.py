"""Row contracts of record manifests: every violated rule is named, nothing fails silently."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "tessera.manifest.v1"

MANIFEST = T.StructType(
    [
        T.StructField("utt_id", T.StringType(), False),
        T.StructField("dataset", T.StringType(), False),
        T.StructField("audio_relpath", T.StringType(), False),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("language", T.StringType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("domain", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("record_type", T.StringType(), False),
        T.StructField("sample_rate_hz", T.IntegerType(), False),
        T.StructField("num_channels", T.IntegerType(), False),
        T.StructField("num_frames", T.LongType(), False),
        T.StructField("duration_sec", T.DoubleType(), False),
        T.StructField("source_meta", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("schema_version", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class Vocabulary:
    """Values that a manifest may hold; the defaults are fixed values of the two public speech corpora."""

    datasets: tuple[str, ...] = ("gsc_v2", "mdsc")
    languages: tuple[str, ...] = ("en", "zh-CN")
    splits: tuple[str, ...] = ("train", "dev", "test")
    domains: tuple[str, ...] = ("standard", "control", "dysarthria")
    roles: tuple[str, ...] = ("train", "enrollment", "eval", "none")
    record_types: tuple[str, ...] = ("speech", "noise")
    schema_version: str = SCHEMA_VERSION


def path_problem(path: Column) -> Column:
    """Name of what makes a path unsafe, or null: it must be relative, without drive and without '..'."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(slashes, "/")
    absolute = slashes.startswith("/") | F.element_at(parts, 1).contains(":")
    return F.when(absolute, "absolute_path").when(F.exists(parts, lambda p: p == ".."), "escaping_path")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _not_in(c: Column, values: tuple[str, ...]) -> Column:
    return c.isNull() | ~c.isin(*values)


def manifest_rules(v: Vocabulary = Vocabulary()) -> dict[str, Column]:
    """Rule name to the condition under which a row violates it."""
    c = F.col
    gsc, mdsc = c("dataset") == "gsc_v2", c("dataset") == "mdsc"
    speech = c("record_type") == "speech"
    rules = {
        "schema_version": ~c("schema_version").eqNullSafe(v.schema_version),
        "utt_id": _blank(c("utt_id")),
        "dataset": _not_in(c("dataset"), v.datasets),
        "audio_relpath": _blank(c("audio_relpath")),
        "absolute_path": path_problem(c("audio_relpath")) == "absolute_path",
        "escaping_path": F.exists(F.split(F.replace(c("audio_relpath"), F.lit("\\"), F.lit("/")), "/"), lambda p: p == ".."),
        "language": _not_in(c("language"), v.languages),
        "split": _not_in(c("split"), v.splits),
        "domain": _not_in(c("domain"), v.domains),
        "role": _not_in(c("role"), v.roles),
        "record_type": _not_in(c("record_type"), v.record_types),
        "speech_speaker": speech & _blank(c("speaker_id")),
        "speech_text": speech & c("label").isNull() & c("transcript").isNull(),
        "noise_role": (c("record_type") == "noise") & (c("role") != "none"),
    }
    for n in ("sample_rate_hz", "num_channels", "num_frames", "duration_sec"):
        rules[n] = c(n).isNull() | (c(n) <= 0)
    if "gsc_v2" in v.datasets:
        rules |= {"gsc_language": gsc & (c("language") != "en"), "gsc_domain": gsc & (c("domain") != "standard"), "gsc_role": gsc & speech & (c("role") != "train")}
    if "mdsc" in v.datasets:
        rules |= {"mdsc_language": mdsc & (c("language") != "zh-CN"), "mdsc_domain": mdsc & ~c("domain").isin("control", "dysarthria")}
    return rules


def with_violations(rows: DataFrame, rules: dict[str, Column] | None = None, name: str = "violations") -> DataFrame:
    """Adds the array of violated rule names, in the order of the rules."""
    rules = manifest_rules() if rules is None else rules
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()])
    return rows.withColumn(name, F.filter(found, lambda x: x.isNotNull()))


def fail_closed(rows: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows unchanged; running them fails at the first row that violates a rule."""
    checked = with_violations(rows, rules, "__violations")
    message = F.concat(F.lit("contract violated: "), F.array_join("__violations", ","))
    guard = F.when(F.size("__violations") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(guard).drop("__violations")


def unknown_keys(raw: DataFrame, text_col: str = "value", known: tuple[str, ...] = tuple(MANIFEST.names)) -> DataFrame:
    """Rows of JSON text with keys that the schema lacks, which readers would drop without a word."""
    extra = F.array_except(F.json_object_keys(text_col), F.array(*[F.lit(k) for k in known]))
    return raw.withColumn("unknown", extra).where(F.size("unknown") > 0)


def sealed_fields(schema: T.StructType, word: str = "test", prefix: str = "") -> list[str]:
    """Paths of fields, nested ones included, whose names hold a sealed word."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += [path] * (word in f.name.lower())
        inner = f.dataType
        while isinstance(inner, (T.ArrayType, T.MapType)):
            inner = inner.elementType if isinstance(inner, T.ArrayType) else inner.valueType
        if isinstance(inner, T.StructType):
            out += sealed_fields(inner, word, f"{path}.")
    return out


def refuse_sealed(df: DataFrame, word: str = "test") -> DataFrame:
    found = sealed_fields(df.schema, word)
    if found:
        raise ValueError(f"sealed fields: {', '.join(found)}")
    return df


def window_batch_problems(samples: Column, length: int) -> Column:
    """Violations of a fixed window of samples in [-1, 1]."""
    return F.filter(F.array(F.when(F.size(samples) != length, "length"), F.when(F.exists(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1)), "range")), lambda x: x.isNotNull())
