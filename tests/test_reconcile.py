from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from casetrail import schemas
from casetrail.operators import reconcile
from casetrail.operators.reconcile import ReconcileOptions
from casetrail.plans import domain

STRICT = ReconcileOptions(require_hash_match=True)


def manifest(spark, *items):
    """Items as dicts; missing fields are null."""
    names = schemas.MANIFEST.fieldNames()
    defaults = {"job_id": "1", "custodian": "u@x", "path": "p", "size": 1}
    return spark.createDataFrame([tuple({**defaults, **i}.get(n) for n in names) for i in items], schemas.MANIFEST)


def summary(source, collected, options=STRICT):
    found = reconcile.summarize(source, collected, options).collect()
    assert len(found) == 1
    return found[0]


def test_scope_filter_cases(spark, rows):
    data = manifest(
        spark,
        {"item_id": "top", "path": "RecoverableItems/x"},
        {"item_id": "inner", "path": "a/RecoverableItems/x"},
        {"item_id": "empty", "custodian": "", "path": "A\\b"},
        {"item_id": "other", "custodian": "v@x"},
        {"item_id": "case", "custodian": "U@X"},
        {"item_id": "folder", "path": "d/"},
    )
    kept = rows(reconcile.scope_filter(data, STRICT, custodian="u@x"), "item_id", "path")
    assert kept == [("case", "p"), ("empty", "a/b"), ("top", "recoverableitems/x")]
    strict = replace(STRICT, strict_system_paths=True, include_folders=True, normalize_paths=False)
    kept = rows(reconcile.scope_filter(data, strict, custodian="u@x"), "item_id", "path")
    assert kept == [("case", "p"), ("empty", "A\\b"), ("folder", "d/")]


def test_hash_compare_ignores_case_and_empties(spark):
    source = manifest(
        spark, {"item_id": "1", "sha256": "AB"}, {"item_id": "2", "sha256": "ab"}, {"item_id": "3", "sha256": "ab"}
    )
    collected = manifest(
        spark, {"item_id": "1", "sha256": "ab"}, {"item_id": "2", "sha256": ""}, {"item_id": "3", "sha256": "cd"}
    )
    assert summary(source, collected).hash_mismatch_count == 1
    assert summary(source, collected, ReconcileOptions()).hash_mismatch_count == 0


@pytest.mark.parametrize(
    ("counts", "options", "expected"),
    [
        ((1000, 0, 1_000_000, 999_000), ReconcileOptions(), (True, True)),
        ((1000, 1, 1_000_000, 1_000_000), ReconcileOptions(), (False, True)),
        ((0, 0, 0, 0), ReconcileOptions(), (True, True)),
        ((0, 1, 0, 1), ReconcileOptions(), (False, False)),
        ((1000, 0, 1_000_000, 998_900), ReconcileOptions(), (True, False)),
        ((1000, 1, 1, 1), ReconcileOptions(extra_tolerance_pct=0), (False, True)),
        ((1000, 1, 1, 1), ReconcileOptions(extra_tolerance_pct=0.1), (True, True)),
    ],
)
def test_gates(spark, counts, options, expected):
    source_count, extra, source_bytes, collected_bytes = counts
    frame = spark.createDataFrame(
        [(source_count, source_count + extra, 0, extra, 0, source_bytes, collected_bytes)],
        "source_count long, collected_count long, missed_count long, extra_count long, hash_mismatch_count long, "
        "source_bytes long, collected_bytes long",
    )
    row = reconcile.gates(frame, options).first()
    assert (row.extras_passed, row.size_passed) == expected
    assert row.status == ("Completed" if row.overall_passed else "Failed")
    soft = reconcile.gates(frame, replace(options, soft_fail=True)).first()
    assert soft.status == ("Completed" if row.overall_passed else "CompletedWithWarnings")


GOLDEN = {
    "u0@x.org": (137, 131, 8, 2, 4, 323223, 315579),
    "u1@x.org": (136, 131, 7, 2, 6, 366903, 341932),
    "u2@x.org": (137, 131, 7, 1, 6, 340745, 320260),
    "u3@x.org": (136, 129, 8, 1, 6, 307994, 292076),
    "u4@x.org": (137, 131, 8, 2, 4, 309152, 300323),
    "u5@x.org": (136, 129, 8, 1, 5, 347495, 314391),
    "u6@x.org": (136, 127, 9, 0, 5, 302401, 285542),
}


def test_golden_counts(spark):
    sf = "/root/testdata/sf0.01"
    found = reconcile.summarize(domain.source_manifest(spark, sf), domain.collected_manifest(spark, sf), STRICT)
    got = {r.scope_custodian: r for r in found.collect()}
    for custodian, expected in GOLDEN.items():
        r = got[custodian]
        assert expected == (
            r.source_count, r.collected_count, r.missed_count, r.extra_count, r.hash_mismatch_count,
            r.source_bytes, r.collected_bytes,
        )
        assert not r.cardinality_passed and not r.size_passed
        assert r.extras_passed == (custodian == "u6@x.org")


def test_reconcile_with_itself_passes(spark, small):
    data = domain.source_manifest(spark, small)
    for row in reconcile.summarize(data, data, STRICT).collect():
        assert row.overall_passed and row.missed_count == row.extra_count == row.hash_mismatch_count == 0


def test_swapping_sides_swaps_missed_and_extra(spark, small, rows):
    source, collected = domain.source_manifest(spark, small), domain.collected_manifest(spark, small)
    now = F.lit("2024-01-01").cast("timestamp")
    one = reconcile.discrepancies(source, collected, STRICT, now)
    two = reconcile.discrepancies(collected, source, STRICT, now)
    assert rows(one.filter("type = 'Missed'"), "key") == rows(two.filter("type = 'Extra'"), "key")
    assert rows(one.filter("type = 'Extra'"), "key") == rows(two.filter("type = 'Missed'"), "key")
    assert rows(one.filter("type = 'HashMismatch'"), "key") == rows(two.filter("type = 'HashMismatch'"), "key")


def test_duplicates_fail_or_take_the_first(spark, rows):
    source = manifest(spark, {"item_id": "1", "size": 5}, {"item_id": "1", "size": 3}, {"item_id": "2"})
    collected = manifest(spark, {"item_id": "1", "size": 3})
    with pytest.raises(Exception, match="duplicate manifest key: 1"):
        reconcile.summarize(source, collected, ReconcileOptions()).collect()
    row = summary(source, collected, ReconcileOptions(on_duplicate="first"))
    assert (row.source_count, row.source_bytes, row.missed_count) == (2, 4, 1)
    assert rows(reconcile.duplicate_keys(source), "key", "row_count") == [("1", 2)]


def test_hot_key_does_not_multiply(spark):
    hot = spark.range(20_000).select(
        F.lit("1").alias("job_id"), F.lit("u").alias("custodian"), F.lit(None).cast("string").alias("drive_id"),
        F.lit("same").alias("item_id"), F.lit("p").alias("path"), F.col("id").alias("size"),
        F.lit(None).cast("timestamp").alias("last_modified"), F.lit("aa").alias("sha256"),
        F.lit(None).cast("string").alias("storage_uri"), F.lit(None).cast("timestamp").alias("collected_utc"),
        F.lit("File").alias("kind"),
    )
    row = summary(hot, hot, replace(STRICT, on_duplicate="first"))
    assert (row.source_count, row.collected_count, row.overall_passed) == (1, 1, True)


def test_unnamed_rows_take_the_custodian_of_their_job(spark, rows):
    data = manifest(
        spark,
        {"item_id": "1", "custodian": ""},
        {"item_id": "2", "custodian": None},
        {"item_id": "3", "job_id": "9", "custodian": ""},
        {"item_id": "4", "custodian": "own"},
    )
    jobs = spark.createDataFrame([("1", "u@x")], "job_id string, custodian string")
    got = rows(reconcile.fill_custodian(data, jobs), "item_id", "custodian")
    assert got == [("1", "u@x"), ("2", "u@x"), ("3", ""), ("4", "own")]


def test_report_has_sections_and_summary(spark):
    source = manifest(spark, {"item_id": "1", "size": 100}, {"item_id": "2", "size": 100})
    collected = manifest(spark, {"item_id": "1", "size": 100}, {"item_id": "3", "size": 50})
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    skips = reconcile.discrepancies(source, collected, STRICT, now).filter("type = 'Missed'")
    report = reconcile.report(source, collected, STRICT, now, expected_skips=skips).orderBy("ord", "Key").collect()
    assert [r.Section for r in report] == ["Missed", "Extras", "ExpectedSkips", "Summary"]
    assert report[0].LastModified == "0001-01-01T00:00:00Z"
    assert report[-1].DetectedUtc == "2024-05-06T07:08:09Z"
    assert "SizeDeltaBytes:-50 SizeDeltaPct:25.00% ExtrasPct:50.00%" in report[-1].Reason
    assert report[-1].Reason.endswith("SizeTolerancePct:0.1% ExtraTolerancePct:0.05% RequireHashMatch:True")
