import hashlib
import hmac

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealdex.functions import crypto
from sealdex.functions.uid import assign_uids, batch_of, partition_of, uid_bytes, uid_file, uid_pos, uid_text

# RFC 4231 test cases 1 to 3 (keys of at most 32 bytes).
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
]


def _frame(spark, rows, *names):
    return crypto.local_frame(spark, rows, {n: pa.binary() for n in names})


def test_hmac_matches_published_vectors(spark):
    df = _frame(spark, [(k, m) for k, m, _ in VECTORS], "k", "m")
    got = [r.h for r in df.select(F.lower(F.hex(crypto.hmac(crypto.as_key(F.col("k")), F.col("m")))).alias("h")).collect()]
    assert got == [d for _, _, d in VECTORS]


def test_hmac_matches_python_on_extreme_keys(spark):
    keys = [b"\x00" * 32, b"\xff" * 32, bytes(range(32)), bytes(range(224, 256)), b"\x80" + b"\x00" * 31]
    df = _frame(spark, [(k, b"m" + k) for k in keys], "k", "m").select(
        "k", "m", crypto.hmac(F.col("k"), F.col("m")).alias("h")
    )
    for r in df.collect():
        assert bytes(r.h) == hmac.new(bytes(r.k), bytes(r.m), hashlib.sha256).digest()


def test_secret_row_agrees_with_driver_side_mac(spark):
    secrets = crypto.SecretRow(spark, {"k": b"short key"})
    got = spark.range(3).select(secrets.hmac("k", crypto.long_bytes(F.col("id"))).alias("h")).collect()
    assert [bytes(r.h) for r in got] == [crypto.mac(b"short key", i.to_bytes(8, "big")) for i in range(3)]


def test_keys_are_padded_or_cut_to_32_bytes(spark):
    df = _frame(spark, [(b"ab",), (b"x" * 40,)], "k").select(crypto.as_key(F.col("k")).alias("k"))
    assert [bytes(r.k) for r in df.collect()] == [b"ab" + b"\x00" * 30, b"x" * 32]


def test_seal_round_trip_and_layout(spark):
    df = _frame(spark, [(b"plain", b"k" * 32, b"n" * 12, b"here")], "p", "k", "n", "a")
    sealed = df.withColumn("c", crypto.seal(F.col("p"), F.col("k"), F.col("n"), F.col("a")))
    row = sealed.select(
        "c",
        crypto.open_or_fail(F.col("c"), F.col("k"), F.col("a")).alias("good"),
        crypto.open_or_null(F.col("c"), F.col("k"), F.lit(b"there")).alias("elsewhere"),
        crypto.open_or_null(F.col("c"), F.lit(b"z" * 32), F.col("a")).alias("wrong_key"),
        crypto.open_or_null(F.col("p"), F.col("k"), F.col("a")).alias("garbage"),
        crypto.open_or_null(F.col("c"), F.lit(None).cast("binary"), F.col("a")).alias("no_key"),
    ).first()
    assert bytes(row.c)[:12] == b"n" * 12 and len(row.c) == len(b"plain") + crypto.SEAL_OVERHEAD
    assert bytes(row.good) == b"plain"
    assert row.elsewhere is None and row.wrong_key is None and row.garbage is None and row.no_key is None


def test_keys_stay_out_of_plans(spark):
    key = b"VERY-SECRET-KEY-MATERIAL-0123456"
    secrets = crypto.SecretRow(spark, {"k": key})
    df = spark.range(2).select(
        secrets.hmac("k", crypto.long_bytes(F.col("id"))),
        crypto.seal(crypto.long_bytes(F.col("id")), secrets.key("k"), F.lit(b"n" * 12), F.lit(b"")),
    )
    df.collect()
    plan = df._jdf.queryExecution().toString()
    assert "VERY-SECRET" not in plan and key.hex() not in plan.lower()


@pytest.mark.parametrize("name", ["f", "0000000001-000003", "dossier-été"])
def test_uid_codec(spark, name):
    positions = [0, 1, 255, 1 << 33, (1 << 63) - 1]
    df = spark.createDataFrame([(name, p) for p in positions], "file string, pos long")
    df = df.withColumn("uid", uid_bytes(F.col("file"), F.col("pos")))
    rows = df.select(
        "pos", "uid", uid_file(F.col("uid")).alias("f"), uid_pos(F.col("uid")).alias("p"),
        uid_text(F.col("file"), F.col("pos")).alias("t"),
    ).collect()
    for r in rows:
        assert bytes(r.uid) == name.encode() + r.pos.to_bytes(8, "big")
        assert (r.f, r.p, r.t) == (name, r.pos, f"{name}:{r.pos}")


def test_short_uid_is_an_error(spark):
    df = _frame(spark, [(b"12345678",)], "uid")
    with pytest.raises(Exception, match="nine bytes"):
        df.select(uid_file(F.col("uid"))).collect()


def test_assigned_uids_are_distinct_and_name_the_part_file(spark, tmp_path):
    mixed = spark.range(0, 50, 1, 3).unionByName(spark.range(50, 90, 1, 2)).repartition(5, "id")
    for i, df in enumerate([spark.range(0, 70, 1, 4).unionByName(spark.range(70, 90, 1, 3)), mixed]):
        path = str(tmp_path / f"u{i}")
        assign_uids(df, 7).write.parquet(path)
        rows = spark.read.parquet(path).select("file", "pos", "_metadata.file_name").collect()
        assert len({(r.file, r.pos) for r in rows}) == 90
        for r in rows:
            assert batch_of(r.file) == 7
            assert r.file_name.startswith(f"part-{partition_of(r.file):05d}-")
