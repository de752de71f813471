import pytest
from pyspark.sql import functions as F

from tessera.functions.text import compatibility_phrase, normalized_phrase
from tessera.operators import contracts, inventory, views


def record(**changes):
    base = {
        "utt_id": "mdsc:a/b.wav", "dataset": "mdsc", "audio_relpath": "a/b.wav", "speaker_id": "S1", "label": None, "transcript": "开灯", "language": "zh-CN", "split": "train", "domain": "control",
        "role": "train", "record_type": "speech", "sample_rate_hz": 16000, "num_channels": 1, "num_frames": 16000, "duration_sec": 1.0, "source_meta": {}, "schema_version": contracts.SCHEMA_VERSION,
    }
    return base | changes


def manifest(spark, *rows):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in contracts.MANIFEST.fields])
    return spark.createDataFrame([tuple(record(**r)[n] for n in schema.names) for r in rows], schema)


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, []),
        ({"audio_relpath": "/abs/x.wav"}, ["absolute_path"]),
        ({"audio_relpath": "C:\\x.wav"}, ["absolute_path"]),
        ({"audio_relpath": "a/../x.wav"}, ["escaping_path"]),
        ({"speaker_id": " "}, ["speech_speaker"]),
        ({"transcript": None}, ["speech_text"]),
        ({"record_type": "noise", "role": "eval"}, ["noise_role"]),
        ({"dataset": "gsc_v2"}, ["gsc_language", "gsc_domain"]),
        ({"language": "en"}, ["mdsc_language"]),
        ({"domain": "standard"}, ["mdsc_domain"]),
        ({"num_frames": 0, "duration_sec": None}, ["num_frames", "duration_sec"]),
        ({"schema_version": "v0"}, ["schema_version"]),
        ({"split": "eval"}, ["split"]),
    ],
)
def test_rules(spark, change, rules):
    assert contracts.with_violations(manifest(spark, change)).first()["violations"] == rules


def test_fail_closed(spark):
    assert contracts.fail_closed(manifest(spark, {})).count() == 1
    with pytest.raises(Exception, match="contract violated: split"):
        contracts.fail_closed(manifest(spark, {"split": "eval"})).collect()


def test_sealed_fields(spark):
    df = spark.createDataFrame([(1, (2, [(3,)]))], "a int, b struct<test_x int, c array<struct<my_test int>>>")
    assert contracts.sealed_fields(df.schema) == ["b.test_x", "b.c.my_test"]
    with pytest.raises(ValueError, match="sealed"):
        contracts.refuse_sealed(df)


def test_unknown_keys(spark):
    raw = spark.createDataFrame([('{"utt_id": "a", "extra": 1}',), ('{"utt_id": "b"}',)], "value string")
    assert [r.unknown for r in contracts.unknown_keys(raw).collect()] == [["extra"]]


def test_normalizers(spark):
    rows = [("小度<p>小度",), ("Hey　Siri ",), ("Straße\t X",), ("Ｈｅｙ< P >Siri",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(normalized_phrase(F.col("t")).alias("a"), compatibility_phrase("t").alias("b")).collect()
    assert [r.a for r in df][:3] == ["小度小度", "heysiri", "strassex"]
    assert df[3].b == "heysiri" and df[4].a is None and df[4].b is None


def test_views(spark):
    rows = [
        {"utt_id": "1", "transcript": "小度<p>小度", "split": "dev", "role": "eval", "domain": "dysarthria"},
        {"utt_id": "2", "transcript": "帮我打开空调", "split": "dev", "role": "enrollment", "domain": "dysarthria"},
        {"utt_id": "3", "transcript": "打开空调"},
        {"utt_id": "4", "transcript": "hey siri", "label": None, "split": "test"},
    ]
    m = manifest(spark, *rows)
    assert {(r.utt_id, r.task_label) for r in views.personalized_wake(m).collect()} == {("1", "小度小度"), ("2", views.NON_WAKE)}
    assert {(r.utt_id, r.task_label, r.is_wake_word) for r in views.exact_phrases(m).collect()} == {("1", "小度小度", True), ("3", "打开空调", False), ("4", "Hey Siri", True)}
    assert [r.utt_id for r in views.exact_phrases(m, without_wake=True).collect()] == ["3"]
    assert [(r.utt_id, r.task_label) for r in views.open_set(m).collect()] == [("2", views.OPEN_SET)]
    with pytest.raises(Exception, match="unexpected label"):
        views.closed_set(m.withColumn("label", F.lit("x")), ("y",)).collect()


def test_inventory_goldens(spark):
    rows = [
        {"utt_id": "1", "label": "A", "speaker_id": "s1", "role": "train", "domain": "control"},
        {"utt_id": "2", "label": "A", "speaker_id": "s2", "role": "enrollment", "domain": "dysarthria"},
        {"utt_id": "3", "label": "A", "speaker_id": "s2", "role": "eval", "domain": "dysarthria"},
    ]
    r = inventory.label_stats(manifest(spark, *rows)).first()
    assert (r.n, r.speakers, r.n_train, r.n_enrollment, r.n_eval, r.n_control, r.n_dysarthria) == (3, 2, 1, 1, 1, 1, 2)
    m = manifest(spark, {"transcript": "开灯", "speaker_id": "C1"}, {"transcript": "开灯", "speaker_id": "D1", "domain": "dysarthria", "split": "dev"}, {"transcript": "关灯", "speaker_id": "C2"}, {"transcript": "开<p>灯", "speaker_id": "C1"})
    inv = inventory.phrase_inventory(m, normalized_phrase(F.col("transcript")), F.col("transcript"))
    lamp = inv.where("phrase = '开灯'").first()
    assert (lamp.n_variants, lamp.control_train, lamp.dysarthria_train, lamp.dysarthria_speakers) == (2, 2, 0, 1)
    assert lamp.variants[0] == "开灯:2"
    assert inventory.support_sweep(inv, [1], [1]).first().phrases == 1
    leak = manifest(spark, {"speaker_id": "x", "split": "dev"}, {"speaker_id": "x", "split": "test"}, {"speaker_id": "y"})
    assert [(r.speaker_id, r.splits) for r in inventory.leaking_keys(leak, "speaker_id").collect()] == [("x", "dev+test")]


def test_joins_that_must_match(spark):
    left = spark.createDataFrame([("d", "1", "train"), ("d", "2", "dev")], "dataset string, utt_id string, split string")
    full = spark.createDataFrame([("d", "1", "train", 1.0), ("d", "2", "dev", 2.0)], "dataset string, utt_id string, split string, f double")
    assert inventory.must_match(left, full, ["dataset", "utt_id"], ["split"]).count() == 2
    for broken in (full.limit(1), full.withColumn("split", F.lit("train"))):
        with pytest.raises(Exception, match="no matching row"):
            inventory.must_match(left, broken, ["dataset", "utt_id"], ["split"]).collect()
    with pytest.raises(AssertionError):
        inventory.assert_disjoint(left.select("utt_id"), full.select("utt_id"), "overlap")
    reasons = inventory.exclusion_reasons(left, {"first": F.col("utt_id") == "1", "listed": full.select("utt_id")}, "utt_id")
    assert {(r.utt_id, r.reason) for r in reasons.collect()} == {("1", "first"), ("2", "listed")}
