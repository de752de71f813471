"""Secret scan with DataFrame functions only: patterns, and sliding-window entropy per character class.

Base spans come from three patterns. Entropy adds spans: candidate strings are
maximal runs of key characters; a window slides over each, its character counts
and the sum of c * log2(c) are updated by the character that enters and the one
that leaves, and windows whose Shannon entropy reaches their class's threshold
(hex digits; digits and letters of one case; digits and letters of both, with or
without separators) form spans. An allow-list of patterns
for identifiers that are no secrets suppresses candidates. Base spans are never
suppressed.

Everything is computed within a row, so nothing is shuffled and skew of any
column has no effect. Positions are code points, ends exclusive. Null and empty
texts have no spans. Rows that repeat an id, or have none, are scanned each on its
own and keep their id. Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_VALUE_LENGTH = 6

#: Maximal runs of at least this many key characters are candidates; also the entropy window.
WINDOW = 24
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
#: Bits a character from which a window counts, by class; a window of 24 has at most log2(24) = 4.58.
#: A threshold is near the 1 % quantile of 24 random draws from the class's alphabet; runs with separators, as paths
#: and slugs have, need more.
HEX_BITS = 3.2
ONE_CASE_BITS = 3.6
MIXED_BITS = 3.85
SEPARATED_BITS = 4.1
HEX_ONLY = r"^(?:[0-9a-f]+|[0-9A-F]+)$"
ONE_CASE = r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])(?:[a-z0-9]+|[A-Z0-9]+)$"
SEPARATED = r"[/_-]"
MIXED = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
#: Candidates that look random but are no secrets.
ALLOW_LIST = (
    r"(?i)example|placeholder|changeme|dummy|x{6}|0{8}|1234567",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]++[/_-])++[A-Za-z]*$",  # possessive, so that long paths need no deep stack
    r"(.{2,8})\1{3}",
)


def running_total(values: Column) -> Column:
    """Inclusive running totals of an array of whole numbers, in blocks so that long arrays stay cheap."""
    size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1), lambda i: F.slice(values, i * size + 1, size))

    def totals(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x))

    inner = F.transform(blocks, totals)
    before = F.aggregate(inner, F.array(F.lit(0)), lambda done, b: F.array_append(done, F.element_at(done, -1) + F.element_at(b, -1)))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda b, add: F.transform(b, lambda x: x + add)))).otherwise(F.array().cast("array<int>"))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.struct(F.split(text, pattern, -1).alias("between"), found.alias("found")))


def spans_of(matches: Column, kind: int) -> Column:
    """Spans from the pieces between matches and the matches themselves."""
    between, found = matches["between"], matches["found"]
    ends = running_total(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.length(b) + F.length(f)))
    spans = F.zip_with(ends, found, lambda e, f: F.struct((e - F.length(f)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), f.alias("text")))
    return F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>"))


def _c_log_c(window: int) -> Column:
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])


def _bound(value: Column, body) -> Column:
    """``body`` of a value computed once: within lambdas, an expression used at every step is computed at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy_windows(candidate: Column, bits: Column, window: int = WINDOW) -> Column:
    """array<struct<start, end>> within ``candidate``: unions of windows whose entropy is at least ``bits``."""
    table = _c_log_c(window)
    term = lambda c: F.element_at(table, c + 1)
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    grown_by = lambda spans, last: F.when(last["end"] > 0, F.array_append(spans, last)).otherwise(spans)

    def slid(codes: Column, alphabet: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), F.size(alphabet)).alias("counts"),
            F.lit(0.0).alias("total"),
            F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
            span(F.lit(0), F.lit(0)).alias("last"),
        )

        def slide(state: Column, at: Column) -> Column:
            enters = F.element_at(codes, at)
            leaves = F.when(at > window, F.element_at(codes, F.greatest(at - window, F.lit(1)))).otherwise(F.lit(0))
            counts = F.transform(state["counts"], lambda n, i: n + (i + 1 == enters).cast("int") - (i + 1 == leaves).cast("int"))
            grown, shrunk = F.element_at(state["counts"], enters), F.element_at(state["counts"], F.greatest(leaves, F.lit(1)))
            change = F.when(enters == leaves, 0.0).otherwise(term(grown + 1) - term(grown) + F.when(leaves > 0, term(shrunk - 1) - term(shrunk)).otherwise(0.0))
            total = state["total"] + change
            high = (at >= window) & (math.log2(window) - total / window >= bits)
            last = state["last"]
            joins = (last["end"] > 0) & (last["end"] >= at - window)
            spans = F.when(high & ~joins, grown_by(state["spans"], last)).otherwise(state["spans"])
            newest = F.when(high, span(F.when(joins, last["start"]).otherwise(at - window), at)).otherwise(last)
            return F.struct(counts.alias("counts"), total.alias("total"), spans.alias("spans"), newest.alias("last"))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, slide, lambda s: grown_by(s["spans"], s["last"]))

    def coded(chars: Column) -> Column:
        return _bound(F.array_distinct(chars), lambda alphabet: _bound(F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int")), lambda codes: slid(codes, alphabet)))

    return _bound(F.split(candidate, ""), coded)


def _entropy_spans(candidates: Column) -> Column:
    """Entropy spans of the candidates that the allow-list leaves."""

    def suspicious(c: Column) -> Column:
        allowed = F.lit(False)
        for p in ALLOW_LIST:
            allowed = allowed | c["text"].rlike(p)
        return (c["text"].rlike(HEX_ONLY) | c["text"].rlike(ONE_CASE) | c["text"].rlike(MIXED)) & ~allowed

    def within(c: Column) -> Column:
        bits = F.when(c["text"].rlike(HEX_ONLY), HEX_BITS).when(c["text"].rlike(ONE_CASE), ONE_CASE_BITS).when(c["text"].rlike(SEPARATED), SEPARATED_BITS).otherwise(MIXED_BITS)
        return F.transform(entropy_windows(c["text"], bits), lambda s: F.struct((c["start"] + s["start"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + s["end"]).alias("end")))

    return F.flatten(F.transform(F.filter(candidates, suspicious), within))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, text, and spans: base_spans and added_spans, array<struct<start, kind, end>> by start, then kind."""
    df = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    df = df.select("*", find_all(F.col("__text"), ASSIGN).alias("__assign"), find_all(F.col("__text"), ACCESS).alias("__access"), find_all(F.col("__text"), HEX).alias("__hex"), find_all(F.col("__text"), CANDIDATE).alias("__runs"))
    assign = F.filter(spans_of(F.col("__assign"), 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_VALUE_LENGTH)
    base = F.array_sort(F.concat(_plain(assign), _plain(spans_of(F.col("__access"), 1)), _plain(spans_of(F.col("__hex"), 2))))
    df = df.select(*keep, "__text", base.alias("base_spans"), spans_of(F.col("__runs"), 3).alias("__runs"))
    df = df.select(*keep, "__text", "base_spans", F.when(F.size("__runs") > 0, _entropy_spans(F.col("__runs"))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("__added"))
    added = F.filter("__added", lambda a: ~F.exists("base_spans", lambda b: (b["start"] <= a["start"]) & (b["end"] >= a["end"])))
    return df.select(*keep, F.col("__text").alias("__secret_text"), "base_spans", added.alias("added_spans"))


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; texts without one stay as they are, null included."""
    names, kinds = docs.columns, dict(docs.dtypes)
    found = find_secrets(docs, text_col, tuple(names))
    spans = F.array_sort(F.concat("base_spans", "added_spans"))
    text = F.col("__secret_text")
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).alias("parts"))).otherwise(F.struct(F.greatest(x["end"], s["at"]).alias("at"), s["parts"].alias("parts"))),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    some = F.size("base_spans") + F.size("added_spans") > 0
    out = found.withColumn("__masked", F.when(some, cut))
    columns = []
    for n in names:
        if n == text_col:
            columns.append(F.coalesce(F.col("__masked"), F.col(n)).alias(n))
        elif n == length_col:
            columns.append(F.when(some, F.length("__masked")).otherwise(F.col(n)).cast(kinds[n]).alias(n))
        else:
            columns.append(F.col(n))
    return out.select(*columns)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _digest(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"))
