from pyspark.sql import functions as F

from quillstone.functions import ids
from quillstone.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokenize_legal(F.col("t")), t="Điều 7, Khoản_2!") == ["điều", "7", "khoản", "2"]
    assert one(spark, T.tokenize_legal(F.col("t"), exact=True), t="Straße") == ["strasse"]
    assert one(spark, T.tokenize_legal(F.col("t")), t="") == []
    assert one(spark, T.tokenize_code(F.col("t")), t="Điều 5 của 41/2016/TT-NHNN a") == ["điều_5", "điều", "5", "của", "41/2016/tt-nhnn", "41", "2016", "tt", "nhnn", "a"]


def test_refs_and_labels(spark):
    assert one(spark, T.legal_refs(F.col("t")), t="theo Điều  3a và khoản 2, điều 3a, điểm b.") == ["khoản 2", "điều 3a", "điểm b"]
    assert one(spark, T.cited_labels(F.col("t")), t="x [E2] y [E1] z [E2]") == ["E2", "E1"]


def test_redact(spark):
    assert one(spark, T.redact(F.col("t")), t='{"a": {"api_key": "x", "n": 1}, "note": "the password is y"}') == '{"a": {"api_key": "[REDACTED]", "n": 1}, "note": "[REDACTED-SUSPECTED-SECRET]"}'


def test_roles(spark):
    assert one(spark, T.parse_roles(F.col("t")), t='["Admin", "HR"]') == ["Admin", "HR"]
    assert one(spark, T.parse_roles(F.col("t")), t=" Staff , Guest,") == ["Staff", "Guest"]
    assert one(spark, T.parse_roles(F.col("t"), True), t='"Admin"') == ["Admin"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(T.l2_normalize(F.col("a")).alias("u"), T.l2_normalize(F.col("b")).alias("z"), T.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and row["c"] == 0.0


def test_sigmoid_saturates(spark):
    df = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double")
    assert [r["s"] for r in df.select(T.sigmoid(F.col("x")).alias("s")).collect()] == [0.0, 0.5, 1.0]


def test_ids(spark):
    import hashlib

    row = spark.range(1).select(ids.parent_id(F.lit("s"), F.lit("k"), F.lit(1)).alias("p"), ids.chunk_id(F.lit("d"), F.lit(""), F.lit(""), F.lit(7)).alias("c")).first()
    assert row["p"] == "P_" + hashlib.sha256(b"s||k||1").hexdigest()[:16] and row["c"] == "d_MD_007"
    assert ids.collection_name("semantic", 768, "m").startswith("nhnn-semantic-768-")


def test_encryption_round_trip(spark):
    from quillstone.sources.sinks import decrypt, encrypt

    key = F.lit("0123456789abcdef")
    assert spark.range(1).select(decrypt(encrypt(F.lit("bí mật"), key), key).alias("x")).first()["x"] == "bí mật"
