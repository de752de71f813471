"""Task views: filters, normalized labels and constant labels over one manifest."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions.text import blank_to_null, normalized_phrase

NON_WAKE = "__NON_WAKE__"
OPEN_SET = "__OPEN_SET__"

# The wake phrases, and the thirty phrases that most speakers share.
WAKE_PHRASES = ("Hey Siri", "你好小布", "天猫精灵", "小冰小冰", "小度小度", "小德小德", "小溪你好", "小爱同学", "小艺小艺", "灵犀灵犀")
COMMON_PHRASES = (
    "Hey Siri", "你好小布", "全部关闭", "全部打开", "关灯", "关闭空调", "关闭窗帘", "天猫精灵", "小冰小冰", "小度小度",
    "小德小德", "小溪你好", "小爱同学", "小艺小艺", "帮忙暂停", "开启省电", "开灯", "打开上一集", "打开后一集", "打开空调",
    "打开蓝牙", "拉开窗帘", "播放上一首", "播放下一首", "替我取消暂停", "灵犀灵犀", "调到下一频道", "重新开始", "降低音量", "音量调大",
)


def _fold(phrase: str) -> str:
    return "".join(phrase.replace("<p>", "").split()).casefold()


def canonical_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrase whose normalized form equals the text's, or null; a literal map, so no join."""
    table = F.create_map(*[F.lit(x) for p in phrases for x in (_fold(p), p)])
    return F.try_element_at(table, normalized_phrase(text)) if phrases else F.lit(None).cast("string")


def own_text(label: Column, transcript: Column) -> Column:
    """Transcript first, then label: what phrase views compare."""
    return F.coalesce(blank_to_null(transcript), blank_to_null(label))


def _index(rows: DataFrame, view: str, **columns: Column) -> DataFrame:
    return rows.select("utt_id", F.lit(view).alias("task_view"), *[c.alias(n) for n, c in columns.items()], "split", "domain", "role", "speaker_id")


def closed_set(manifest: DataFrame, labels: tuple[str, ...], view: str = "closed_set", strict: bool = True) -> DataFrame:
    """Speech rows by their own label; with ``strict``, running it fails at a label outside the set."""
    speech = manifest.where(F.col("record_type") == "speech")
    inside = F.col("label").isin(*labels)
    if strict:
        speech = speech.where(F.when(F.coalesce(inside, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce("label", F.lit("null")))).cast("boolean")))
    else:
        speech = speech.where(inside)
    return _index(speech, view, task_label=F.col("label"), is_target=F.lit(True), canonical_target=F.col("label"))


def personalized_wake(manifest: DataFrame, phrases: tuple[str, ...] = WAKE_PHRASES, domain: str = "dysarthria", splits: tuple[str, ...] = ("dev", "test"), view: str = "personalized_wake") -> DataFrame:
    """Enrollment and evaluation rows of the domain; what is no wake phrase shares one label."""
    rows = manifest.where((F.col("domain") == domain) & F.col("split").isin(*splits) & F.col("role").isin("enrollment", "eval"))
    target = canonical_phrase(F.coalesce("label", "transcript"), phrases)
    return _index(rows, view, task_label=F.coalesce(target, F.lit(NON_WAKE)), is_target=target.isNotNull(), canonical_target=target)


def common_phrases(manifest: DataFrame, phrases: tuple[str, ...] = COMMON_PHRASES, wake: tuple[str, ...] = WAKE_PHRASES, view: str = "common_phrases") -> DataFrame:
    """Wake phrases by normalized form, the others by the raw label only."""
    target = canonical_phrase(F.col("label"), wake)
    label = F.coalesce(target, F.col("label"))
    return _index(manifest.where(label.isin(*phrases)), view, task_label=label, is_target=target.isNotNull(), canonical_target=target)


def exact_phrases(manifest: DataFrame, phrases: tuple[str, ...] = COMMON_PHRASES, wake: tuple[str, ...] = WAKE_PHRASES, without_wake: bool = False, view: str = "exact_phrases") -> DataFrame:
    """Rows whose normalized text is one of the phrases, by transcript first."""
    text = own_text(F.col("label"), F.col("transcript"))
    chosen = tuple(p for p in phrases if not (without_wake and _fold(p) in {_fold(w) for w in wake}))
    found = canonical_phrase(text, chosen)
    return _index(manifest.where(found.isNotNull()), view, task_label=found, raw_transcript=text, is_wake_word=canonical_phrase(text, wake).isNotNull(), is_open_set=F.lit(False))


def open_set(manifest: DataFrame, phrases: tuple[str, ...] = COMMON_PHRASES, splits: tuple[str, ...] = ("dev", "test"), view: str = "open_set") -> DataFrame:
    """Development and test rows outside the phrases: rejection trials under one constant label."""
    text = own_text(F.col("label"), F.col("transcript"))
    rows = manifest.where(F.col("split").isin(*splits) & text.isNotNull() & canonical_phrase(text, phrases).isNull())
    return _index(rows, view, task_label=F.lit(OPEN_SET), raw_transcript=text, is_wake_word=F.lit(False), is_open_set=F.lit(True))


def duration_bucket(seconds: Column) -> Column:
    """Irregular buckets with closed upper ends, and one for exactly a second."""
    return F.when(seconds == 1, "=1s").when(seconds <= 0.5, "<=0.5s").when(seconds < 1, "<1s").when(seconds <= 2, "<=2s").when(seconds <= 5, "<=5s").when(seconds <= 10, "<=10s").otherwise(">10s")


def class_map(rows: DataFrame, label: str = "task_label", split: str = "train") -> DataFrame:
    """(label, class_id): sorted distinct labels of the training split, numbered from 0."""
    labels = rows.where(F.col("split") == split).select(F.col(label).alias("label")).distinct()
    return numbered(labels)


#: Labels of a range that one task sorts, and the most ranges.
RANGE_LABELS, MOST_RANGES = 500_000, 1024


def numbered(labels: DataFrame, range_labels: int = RANGE_LABELS) -> DataFrame:
    """Distinct labels numbered from 0 in order, null ones left out.

    Labels with the smallest hashes part them into ranges; a label's number is its place in its range after
    the labels of the ranges below, which are counted first. The driver holds one bound and one count a range.
    """
    rows = labels.where(F.col("label").isNotNull())
    ranges = min(MOST_RANGES, max(1, -(-rows.count() // range_labels)))
    bounds = sorted(r["label"] for r in rows.orderBy(F.xxhash64("label"), "label").limit(ranges - 1).collect()) if ranges > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("label"))) if bounds else F.lit(0)
    held = rows.select("label", place.alias("range"))
    counts = {r["range"]: r["n"] for r in held.groupBy("range").agg(F.count("*").alias("n")).collect()} if bounds else {}
    below = list(itertools.accumulate([counts.get(i, 0) for i in range(len(bounds))], initial=0))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("label")) - 1
    return held.select("label", (nth + F.element_at(F.array(*[F.lit(b).cast("long") for b in below]), F.col("range") + 1)).cast("int" if sum(counts.values()) < 1 << 31 else "long").alias("class_id"))


def contiguous(ids: Column) -> list[Column]:
    """Aggregates that tell whether class ids run from 0 without a gap."""
    return [((F.min(ids) == 0) & (F.max(ids) == F.count_distinct(ids) - 1)).alias("contiguous"), F.count_distinct(ids).alias("classes")]


# The type of each outcome that counts as a failure. Confirming an unknown query is none.
FAILURES = {
    "known_wrong_accept": "KNOWN_WRONG_ACCEPT",
    "known_confirm": "KNOWN_CONFIRM",
    "known_reject": "KNOWN_REJECT",
    "known_other": "KNOWN_OTHER",
    "unknown_accept": "UNKNOWN_FALSE_ACCEPT",
}


def failure_rows(rows: DataFrame, known: Column, status: Column, predicted: Column, true: Column, top: Column | None = None) -> DataFrame:
    """Failed decisions with their type, and whether the first candidate was right for all that (known queries only)."""
    group = outcome_group(known, status, predicted, true)
    table = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    ranked_right = known & F.coalesce((predicted if top is None else top) == true, F.lit(False))
    return rows.withColumns({"failure": F.try_element_at(table, group), "ranking_correct": ranked_right}).where(F.col("failure").isNotNull())


def outcome_group(known: Column, status: Column, predicted: Column, true: Column) -> Column:
    """Outcome of a decision: correct or wrong accept, confirm or reject of a known query, or false accept and reject of an unknown one.

    A known query is ``known_other`` if it was accepted without a prediction or a truth, or has no such status at all.
    """
    return (
        F.when(known & (status == "ACCEPT") & (predicted == true), "known_correct_accept")
        .when(known & (status == "ACCEPT") & (predicted != true), "known_wrong_accept")
        .when(known & (status == "CONFIRM"), "known_confirm")
        .when(known & (status == "REJECT"), "known_reject")
        .when(known, "known_other")
        .when(status == "ACCEPT", "unknown_accept")
        .when(status == "CONFIRM", "unknown_confirm")
        .otherwise("unknown_reject")
    )
