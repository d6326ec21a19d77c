import pytest
from pyspark.sql import functions as F

from casetrail.functions import measures, paths, sqlfuncs


def value(spark, column, **fields):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in fields.items()) or "x int"
    row = tuple(v for _, v in fields.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("\\Docs\\\\A.TXT/", "docs//a.txt"),
        ("///a/b//", "a/b"),
        (None, ""),
        ("\\", ""),
    ],
)
def test_normalize_path(spark, given, expected):
    assert value(spark, paths.normalize_path(lit(given))) == expected


def test_primary_key_prefers_item_id(spark):
    key = paths.primary_key(lit("i1"), lit("d"), lit("p"), lit(5, "long"), lit(None, "timestamp"))
    assert value(spark, key) == "i1"


@pytest.mark.parametrize("blank", ["", None])
def test_primary_key_fallback(spark, blank):
    key = paths.primary_key(lit(blank), lit(None), lit("p"), lit(5, "long"), lit(None, "timestamp"))
    assert value(spark, key) == "|p|5|0001-01-01T00:00:00Z"
    full = paths.primary_key(lit(blank), lit("d"), lit("p"), lit(None, "long"), lit("2024-01-02 03:04:05", "timestamp"))
    assert value(spark, full) == "d|p|0|2024-01-02T03:04:05Z"


@pytest.mark.parametrize(
    ("kind", "path", "expected"),
    [("FOLDER", "a", True), (None, "a/", True), (None, "a\\", False), ("File", None, False), (None, None, False)],
)
def test_is_folder(spark, kind, path, expected):
    assert value(spark, paths.is_folder(lit(kind), lit(path))) is expected


@pytest.mark.parametrize(
    ("path", "plain", "strict"),
    [
        ("RecoverableItems/x", False, True),
        ("a/RecoverableItems/x", True, True),
        ("a\\Versions\\x", True, True),
        ("a/recyclebin", False, False),
    ],
)
def test_system_path(spark, path, plain, strict):
    assert value(spark, paths.is_system_path(lit(path))) is plain
    assert value(spark, paths.is_system_path(lit(path), strict=True)) is strict


@pytest.mark.parametrize(
    ("name", "expected"), [("A.DOCX", ".docx"), ("a", ""), ("a.", ""), ("a.b.C", ".c"), ("x.y/z", "")]
)
def test_file_extension(spark, name, expected):
    assert value(spark, paths.file_extension(lit(name))) == expected


def test_file_names(spark):
    assert value(spark, paths.sanitize_file_name(lit('a<b>:"c|?*\\/\td'))) == "a_b___c______d"
    assert value(spark, paths.sanitize_file_name_drop(lit("a:b" * 80))) == "ab" * 50
    path = paths.output_path(lit("base"), lit("m"), lit("u@x"), lit(7, "int"), lit(None))
    assert value(spark, path) == "base/matter/m/GDC/u@x/000007_unknown_file"


def test_path_metadata(spark):
    path = lit("/land/MatterA/u1@x.org/files/dataset.json")
    assert value(spark, paths.path_custodian(path)) == "u1@x.org"
    assert value(spark, paths.path_matter(path)) == "u1@x.org"
    assert value(spark, paths.path_custodian(lit("/a/b"))) == "unknown"
    assert value(spark, paths.path_matter(lit("/a/b"))) == "DefaultMatter"


def test_identifiers(spark):
    assert value(spark, paths.scope_id(lit("Mail"), lit("U@X.org"))) == "mail:u@x.org"
    ident = paths.shard_identifier(
        lit("u@x.org"), lit("2024-01-01", "timestamp"), lit("2024-01-31 12:00:00", "timestamp")
    )
    assert value(spark, ident) == "u_20240101_20240131"


def test_message_size_and_recipients(spark):
    assert value(spark, measures.estimate_message_size(lit("Hi"), lit("abc"))) == 1034
    assert value(spark, measures.estimate_message_size(lit(None), lit(None))) == 1024
    to = F.expr("array(named_struct('address', 'a'), named_struct('address', cast(null as string)))")
    assert value(spark, measures.join_recipients(to)) == "a;"


@pytest.mark.parametrize(
    ("job_type", "start", "end", "expected"),
    [
        ("Email", "2024-01-01", "2024-01-08", "High"),
        ("Email", "2024-01-01", "2024-01-09", "Normal"),
        ("Email", "2024-01-01", None, "Normal"),
        ("Teams", None, None, "High"),
        ("Mixed", None, None, "Medium"),
        ("OneDrive", None, None, "Normal"),
    ],
)
def test_priority(spark, job_type, start, end, expected):
    as_of = lit("2024-06-01", "timestamp")
    column = measures.request_priority(lit(job_type), lit(start, "timestamp"), lit(end, "timestamp"), as_of)
    assert value(spark, column) == expected


@pytest.mark.parametrize(
    ("job_type", "days", "minutes"),
    [("Email", 10, 30), ("OneDrive", 100, 300), ("Teams", 100, 150), ("Email", 16, 32), ("Fax", 900, 30)],
)
def test_duration(spark, job_type, days, minutes):
    start = lit("2024-01-01", "timestamp")
    end = F.timestamp_add("DAY", F.lit(days), start)
    assert value(spark, measures.estimated_minutes(lit(job_type), start, end, start)) == minutes


def test_progress(spark):
    def progress(done, estimate):
        column = measures.progress_percentage(lit(done, "long"), lit(estimate, "long"), F.lit(12.5))
        return value(spark, column)

    assert progress(5, 0) == 12.5
    assert progress(5, 20) == 25.0
    assert progress(50, 20) == 100.0


@pytest.mark.parametrize(
    ("status", "message", "expected"),
    [
        (429, None, True),
        (500, None, True),
        (599, None, True),
        (600, None, False),
        (404, None, False),
        (None, "Network unreachable", True),
        (None, "denied", False),
        (None, None, False),
    ],
)
def test_retryable(spark, status, message, expected):
    assert value(spark, measures.is_retryable(lit(status, "int"), lit(message))) is expected


def test_rates_are_zero_without_duration(spark):
    assert value(spark, measures.items_per_second(lit(10, "long"), lit(0, "long"))) == 0.0
    assert value(spark, measures.items_per_second(lit(10, "long"), lit(500, "long"))) == 20.0
    assert value(spark, measures.megabytes_per_second(lit(1048576, "long"), lit(500, "long"))) == 2.0


def test_checkpoint_payload_shapes(spark):
    data = '{"TeamId":"t","ChannelId":"c","ItemsProcessedInChannel":3,"ProcessedMessageIds":["a"]}'
    got = value(spark, measures.checkpoint_payload(lit(data)))
    assert (got.container, got.items_processed, got.processed_ids) == ("t/c", 3, ["a"])


def test_sql_functions_agree_with_columns(spark):
    sqlfuncs.register(spark)
    frame = spark.createDataFrame(
        [("\\A\\B.TXT/", "folder", None, 5, 503, "x"), ("a/b:c.Doc", "File", "i", None, None, "TimeOut")],
        "p string, kind string, id string, size long, status int, msg string",
    )
    frame.createOrReplaceTempView("sample")
    by_sql = spark.sql(
        """SELECT normalize_path(p), is_folder_path(kind, p), manifest_key(id, 'd', p, size, NULL), file_extension(p),
             sanitize_file_name(p), sha256_hex(p), delta_scope_id('Mail', p), estimate_message_size(p, msg),
             is_retryable(status, msg), estimate_job_bytes('Teams'), estimate_job_items('Fax'),
             progress_percentage(5, size, 1.0D), sanitize_file_name_drop(p), estimate_minutes('Teams', 100),
             request_priority('Email', 7), items_per_second(size, 500) FROM sample"""
    )
    by_column = frame.select(
        paths.normalize_path(F.col("p")),
        paths.is_folder(F.col("kind"), F.col("p")),
        paths.primary_key(F.col("id"), F.lit("d"), F.col("p"), F.col("size"), F.lit(None).cast("timestamp")),
        paths.file_extension(F.col("p")),
        paths.sanitize_file_name(F.col("p")),
        measures.sha256_hex(F.col("p")),
        paths.scope_id(F.lit("Mail"), F.col("p")),
        measures.estimate_message_size(F.col("p"), F.col("msg")),
        measures.is_retryable(F.col("status"), F.col("msg")),
        measures.estimated_bytes(F.lit("Teams")),
        measures.estimated_items(F.lit("Fax")),
        measures.progress_percentage(F.lit(5), F.col("size"), F.lit(1.0)),
        paths.sanitize_file_name_drop(F.col("p")),
        F.lit(150.0),
        F.lit("High"),
        measures.items_per_second(F.col("size"), F.lit(500)),
    )
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_column.collect()))
    plan = by_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
