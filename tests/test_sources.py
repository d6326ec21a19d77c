"""Readers and writers on small hand-made files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casetrail import schemas
from casetrail.operators import custody, ingest
from casetrail.plans import domain
from casetrail.sinks import files
from casetrail.sinks.cursors import CursorStore
from casetrail.sources import datasets, landing, logs, manifests


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_arity_quotes_and_aliases(spark, tmp_path, rows):
    path = put(
        tmp_path / "m.csv",
        'Custodian,"File_Path",Size,Hash,path,Modified\n'
        'u,"old","12",ab,"a ""q"", b",2024-01-02T03:04:05Z\n'
        "u,x,1\n"
        "u,x,1,h,p,2024-01-01,extra\n"
        "u,x,1,h,,2024-01-01\n"
        "u,x,1.5,h,p2,not a date\n",
    )
    good, rejects = manifests.read_manifest(spark, path)
    got = good.orderBy("path").collect()
    assert [(r.path, r.size, r.sha256) for r in got] == [('a "q", b', 12, "ab"), ("p2", 0, "h")]
    assert got[0].last_modified.isoformat() == "2024-01-02T03:04:05" and got[1].last_modified is None
    assert rows(rejects, "reason") == [("no path",), ("wrong number of values",), ("wrong number of values",)]


def test_json_lines_bad_lines_and_name_case(spark, tmp_path, rows):
    path = put(
        tmp_path / "m.jsonl",
        '{"PATH":"p1","itemid":"i1","Size":5,"sha256":null}\n\nnot json\n{"Path":"p2","size":"big"}\n{"custodian":"u"}\n',
    )
    good, rejects = manifests.read_manifest(spark, path)
    assert rows(good, "path", "item_id", "size", "custodian") == [("", None, 0, "u"), ("p1", "i1", 5, "")]
    assert rows(rejects, "reason") == [("not a JSON object",), ("wrong value type",)]


def test_json_array(spark, tmp_path, rows):
    data = [{"Path": "p1", "ItemId": "i1", "Size": 5, "LastModified": "2024-01-01T00:00:00Z"}, {"path": "p2"}]
    path = put(tmp_path / "m.json", "\n  " + json.dumps(data, indent=2))
    good, rejects = manifests.read_manifest(spark, path)
    assert rows(good, "path", "item_id", "size") == [("p1", "i1", 5), ("p2", None, 0)]
    assert good.filter("item_id = 'i1'").first().last_modified.isoformat() == "2024-01-01T00:00:00"
    assert rejects.count() == 0


def test_every_csv_file_has_its_own_header(spark, tmp_path, rows):
    put(tmp_path / "m" / "a.csv", "Custodian,ItemId,Path,Size\nu,i1,p1,10\n")
    put(tmp_path / "m" / "b.csv", '\ufeff"Size","File, Path",Path,Custodian,Hash\n20,x,"p,2",v,h\n1,2,3\n')
    put(tmp_path / "m" / "c.csv", "")
    good, rejects = manifests.read_manifest(spark, str(tmp_path / "m"), "csv")
    assert rows(good, "custodian", "item_id", "path", "size", "sha256") == [("u", "i1", "p1", 10, None), ("v", None, "p,2", 20, "h")]
    assert rows(rejects, "raw", "reason") == [("1,2,3", "wrong number of values")]


def test_lines_and_arrays_in_one_folder(spark, tmp_path, rows):
    put(tmp_path / "m" / "a.json", '{"Path":"p1","Size":1}\n{"Path":"p2"}\n')
    put(tmp_path / "m" / "b.json", '\n [{"path":"p3","size":3},\n {"path":"p4","size":"x"}, 7]')
    put(tmp_path / "m" / "c.json", "[broken")
    good, rejects = manifests.read_manifest(spark, str(tmp_path / "m"), "json")
    assert rows(good, "path", "size") == [("p1", 1), ("p2", 0), ("p3", 3)]
    assert sorted(r.reason for r in rejects.collect()) == ["not a JSON object", "not a JSON object", "wrong value type"]
    put(tmp_path / "r" / "a.json", json.dumps(RECORD) + "\n")
    put(tmp_path / "r" / "b.json", json.dumps([{**RECORD, "id": "i2"}, {**RECORD, "id": "i3"}], indent=1))
    good, rejects = datasets.read_file_records(spark, str(tmp_path / "r"))
    assert rows(good, "id", "size") == [("i1", 128), ("i2", 128), ("i3", 128)] and rejects.isEmpty()


def test_missing_unknown_and_parquet(spark, tmp_path, small, rows):
    good, rejects = manifests.read_manifest(spark, str(tmp_path / "none.csv"))
    assert good.count() == 0 and good.columns == manifests.ROW_SCHEMA.fieldNames()
    with pytest.raises(ValueError, match="unsupported"):
        manifests.read_manifest(spark, "a.xlsx")
    source = domain.source_manifest(spark, small)
    path = str(tmp_path / "m.parquet")
    source.drop("storage_uri").write.parquet(path)
    good, _ = manifests.read_manifest(spark, path)
    assert rows(good, "path", "size") == rows(source, "path", "size")


RECORD = {
    "driveId": "d1",
    "id": "i1",
    "parentReference": {"driveId": "d9"},
    "name": "a.txt",
    "lastModifiedDateTime": "2024-10-06T19:00:00Z",
    "size": 128,
    "file": {"mimeType": "text/plain", "hashes": {"sha256Hash": "ab"}},
}


def test_file_records_lines_array_and_bad_lines(spark, tmp_path, rows):
    lines = put(tmp_path / "MatterA" / "u1@x.org" / "files" / "d.json", json.dumps(RECORD) + "\n{broken\n")
    good, rejects = datasets.read_file_records(spark, lines)
    assert rows(good, "id", "custodian", "matter", "file.hashes.sha256Hash") == [("i1", "u1@x.org", "u1@x.org", "ab")]
    assert rows(rejects, "raw") == [("{broken",)]
    array = put(tmp_path / "array.json", json.dumps([RECORD, {**RECORD, "id": "i2", "folder": {"childCount": 1}}]))
    good, _ = datasets.read_file_records(spark, array)
    assert rows(ingest.filter_records(good), "id") == [("i1",)]


def test_extension_and_date_filters(spark, rows):
    import datetime as dt

    data = [
        ("keep", "A.DOCX", None, True, False),
        ("noname", None, None, True, False),
        ("folder", "B.docx", None, True, True),
        ("other", "c.txt", None, True, False),
        ("old", "d.docx", dt.datetime(2020, 1, 1), True, False),
    ]
    frame = spark.createDataFrame(data, "id string, name string, m timestamp_ntz, f boolean, d boolean").selectExpr(
        "id", "cast(null as string) AS fileName", "name", "cast(m AS timestamp) AS lastModifiedDateTime",
        "CASE WHEN f THEN named_struct('mimeType', 'x') END AS file",
        "CASE WHEN d THEN named_struct('childCount', 1) END AS folder", "'u' AS custodian",
    )
    after = F.lit("2021-01-01").cast("timestamp")
    assert rows(ingest.filter_records(frame, [".docx"], after), "id") == [("keep",)]
    assert len(rows(ingest.filter_records(frame), "id")) == 4
    assert rows(ingest.filter_records(frame, custodians=["v"]), "id") == []


def test_cut_off_after_second_failure(spark):
    outcomes = ["Success", "Failed", "Success", "Failed", "Success"]
    frame = spark.createDataFrame(
        [("d", i, o, 10) for i, o in enumerate(outcomes)], "dataset string, record_index long, outcome string, bytes_fetched long"
    )
    row = ingest.fetch_summary(ingest.cut_off(frame, "dataset", 2), "dataset", 2).first()
    assert (row.total_records, row.successful, row.failed, row.success) == (5, 2, 2, False)
    row = ingest.fetch_summary(ingest.cut_off(frame, "dataset", 3), "dataset", 3).first()
    assert (row.successful, row.failed, row.success) == (3, 2, True)


def test_content_is_hashed_where_it_lies(spark, tmp_path):
    put(tmp_path / "c" / "a.bin", "alpha")
    put(tmp_path / "c" / "deep" / "b.bin", "beta" * 100)
    put(tmp_path / "c" / "large é.bin", "x" * (9 << 20))
    inventory = {r.content_length: r for r in datasets.read_content(spark, str(tmp_path / "c")).collect()}
    row = inventory[5]
    assert row.content_sha256 == hashlib.sha256(b"alpha").hexdigest()
    assert inventory[400].content_sha256 == hashlib.sha256(b"beta" * 100).hexdigest()
    assert inventory[9 << 20].content_sha256 == hashlib.sha256(b"x" * (9 << 20)).hexdigest()
    ids = spark.createDataFrame([("1", hashlib.sha256(b"alpha").hexdigest().upper()), ("2", "x"), ("3", "y")], "id string, sha256 string")
    known = spark.createDataFrame([("1", row.content_sha256), ("2", row.content_sha256)], "id string, content_sha256 string")
    got = {r.id: r.outcome for r in custody.rehash_check(ids, known, "id").collect()}
    assert got == {"1": "Match", "2": "Mismatch", "3": "Missing"}


def test_landing_discovery_on_disk(spark, tmp_path, rows):
    put(tmp_path / "run1" / "_SUCCESS", "")
    put(tmp_path / "run1" / "part-0.json", "{}")
    put(tmp_path / "run1" / "deep" / "part-1.json", "{}")
    put(tmp_path / "run2" / "part-2.json", "{}")
    put(tmp_path / "run2" / "my-dataset.json", "{}")
    put(tmp_path / "run3" / "x.complete", "")
    put(tmp_path / "run3" / "part-3.json", "{}")
    put(tmp_path / "a/b/c/d/e/f/g/h" / "_SUCCESS", "")
    put(tmp_path / "a/b/c/d/e/f/g/h" / "part-9.json", "{}")
    root = str(tmp_path)
    found = landing.discover_datasets(landing.list_files(spark, root), landing.marker_files(spark, root))
    names = sorted(r.path.rsplit("/", 1)[1] for r in found.collect())
    assert names == ["my-dataset.json", "part-0.json", "part-1.json", "part-3.json", "part-9.json"]


def test_pairing_tries_patterns_in_order(spark):
    listing = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    collected = listing("/c/a_b_7_collected.csv", "/c/u_8_collected.csv", "/c/u_9_collected.csv", "/c/x.csv", "/c/v_5_collected.csv")
    sources = listing("/s/a_b_source.json", "/s/source_7.csv", "/s/u_8_source.json", "/s/u_source.csv")
    got = landing.pair_manifests(collected, sources, listing("/r/recon_report_9.csv")).collect()
    assert {(r.custodian, r.job_id, r.source_path) for r in got} == {
        ("a_b", "7", "/s/a_b_source.json"),
        ("u", "8", "/s/u_8_source.json"),
        ("v", "5", None),
    }


LOG = """[2031-03-04 05:06:07.008 +02:00] AUDIT: MatterOpened | Custodian: null | CorrelationId: a-1 | Data: {"Action":"MatterOpened","Data":{"JobType":"Chat"}}
[2031-03-04 05:06:08.000 +02:00] PERFORMANCE: Hash.Batch | Duration: 45ms | Items: 6 | Size: 77 bytes | CorrelationId: b-2 | Throughput: 133.33 items/sec, 0.00 MB/sec
[2031-03-04 05:06:09.000 +02:00] GRAPH_API: PATCH /sites/blue room | Status: 503 | Duration: 31ms | CorrelationId: c-3 | Quota: 12% left
[2031-03-04 05:06:10.000 +02:00 WRN] DATA_COLLECTION: w@y.org | Type: Chat | Route: GraphDataConnect | Items: 8 | Size: 2.25 MB | CorrelationId: d-4
[2031-03-04 05:06:11.000 +02:00] SECURITY: KeyRotated | CorrelationId: e-5 | User: keeper | Data: {"Event":"KeyRotated"}
[2031-03-04 05:06:12.000 +02:00] ERROR: Uploading part | Exception: IOException | CorrelationId: f-6 | Data: {"Context":"Uploading part"}
[2031-03-04 05:06:13.000 +02:00] CHAIN_OF_CUSTODY: Sealed | ItemId: item 9 | Hash: abc123 | CorrelationId: g-7 | Data: {}
[2031-03-04 05:06:14.000 +02:00] Ran a statement
SELECT 2;
"""


def test_compliance_log(spark, tmp_path):
    parsed, unmatched = logs.read_log(spark, put(tmp_path / "a.log", LOG))
    got = {r.category: r for r in parsed.withColumn("data_type", logs.data_field("$.Data.JobType")).collect()}
    assert set(got) == {*logs.CATEGORIES, None}
    assert got["AUDIT"].ts.isoformat() == "2031-03-04T03:06:07.008000"
    assert (got["AUDIT"].name, got["AUDIT"].custodian, got["AUDIT"].data_type) == ("MatterOpened", None, "Chat")
    assert (got["PERFORMANCE"].duration_ms, got["PERFORMANCE"].item_count, got["PERFORMANCE"].size_bytes) == (45, 6, 77)
    api = got["GRAPH_API"]
    assert (api.method, api.endpoint, api.status_code, api.duration_ms, api.quota) == ("PATCH", "/sites/blue room", 503, 31, "12% left")
    collected = got["DATA_COLLECTION"]
    assert (collected.custodian, collected.job_type, collected.route) == ("w@y.org", "Chat", "GraphDataConnect")
    assert (collected.item_count, collected.size_bytes, collected.correlation_id) == (8, 2_359_296, "d-4")
    assert (got["SECURITY"].name, got["SECURITY"].user_context) == ("KeyRotated", "keeper")
    assert (got["ERROR"].name, got["ERROR"].exception_type) == ("Uploading part", "IOException")
    assert (got["CHAIN_OF_CUSTODY"].item_id, got["CHAIN_OF_CUSTODY"].hash) == ("item 9", "abc123")
    assert got[None].message == "Ran a statement"
    assert [r.value for r in unmatched.collect()] == ["SELECT 2;"]


def test_manifest_digest_sidecar(spark, tmp_path, small):
    path = files.write_manifest_csv(domain.collected_manifest(spark, small), str(tmp_path / "m"))
    target = files.write_manifest_digest(spark, path, str(tmp_path / "digest"))
    parts = sorted(tmp_path.joinpath("m").glob("*.csv"))
    inner = "".join(hashlib.sha256(p.read_bytes()).hexdigest() for p in parts)
    (line,) = [r.value for r in spark.read.text(target).collect()]
    assert line.startswith(hashlib.sha256(inner.encode()).hexdigest())
    header = parts[0].read_text().splitlines()[0]
    assert header == "Custodian,Kind,DriveId,ItemId,Path,Size,SHA256,StorageUri,CollectedUtc"


def test_job_manifest_csv_and_parts(spark, tmp_path, small, rows):
    items = domain.items(spark, small).filter("job_id < 40")
    jobs = domain.jobs(spark, small).filter("job_id < 40")
    built = custody.job_manifests(jobs, items, F.lit("2024-01-01").cast("timestamp"))
    sequenced = custody.collection_sequence(items)
    path = files.write_job_manifest_csv(built, sequenced, str(tmp_path / "jobs"))
    written = spark.read.option("header", True).csv(path)
    assert written.filter("Type = 'MANIFEST_HEADER'").count() == jobs.count()
    assert written.filter("Type = 'ITEM'").count() == items.count()
    parts = files.job_document_items(sequenced, part_items=2).groupBy("job_id", "part").agg(F.count(F.lit(1)).alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 2
    totals = built.filter("total_items > 0").select("job_id", "total_items")
    assert rows(parts.groupBy("job_id").agg(F.sum("n"))) == rows(totals)


def test_cursor_store_versions(spark, tmp_path, small):
    from casetrail.operators import delta

    store = CursorStore(spark, str(tmp_path / "cursors"))
    assert store.load().count() == 0
    first = delta.latest_cursors(domain.cursors(spark, small))
    store.save(first)
    store.upsert(store.load().limit(3).withColumn("delta_token", F.lit("new")))
    assert store.load().filter("delta_token = 'new'").count() == 3
    assert store.load().count() == first.count()
    store.remove(store.load().filter("delta_token = 'new'"))
    assert store.load().count() == first.count() - 3
    assert store.versions() == [1, 2, 3]
    assert store.load(before=2).count() == first.count()


def test_cursor_store_compacts(spark, tmp_path, small, monkeypatch):
    from casetrail.operators import delta
    from casetrail.sinks import cursors

    monkeypatch.setattr(cursors, "COMPACT_AFTER", 2)
    store = CursorStore(spark, str(tmp_path / "cursors"))
    first = delta.latest_cursors(domain.cursors(spark, small))
    store.save(first)
    for n in range(6):
        store.upsert(store.load().orderBy("scope_id").limit(2).withColumn("delta_token", F.lit(f"t{n}")))
    assert store.load().count() == first.count() and store.load().filter("delta_token = 't5'").count() == 2
    # Folders before the last base but one are gone.
    assert store.versions()[0] > 1 and store.versions()[-1] == 7


def test_tables_and_empty_file(spark, tmp_path):
    spark.createDataFrame([], schemas.CHECKPOINT).write.parquet(str(tmp_path / "db" / "checkpoints"))
    assert datasets.read_table(spark, str(tmp_path / "db"), "checkpoints").columns == schemas.CHECKPOINT.fieldNames()
    assert manifests.read_manifest(spark, put(tmp_path / "e.csv", ""))[0].count() == 0


def test_folders_are_released(spark, tmp_path):
    from casetrail import workspace

    workspace._HANDED_OUT.pop(spark.sparkContext.applicationId, None)
    path = workspace.new_folder(spark, "short")
    spark.range(3).write.parquet(path)
    assert workspace.release(spark) == 1 and workspace.release(spark) == 0
    assert not workspace.has_names(spark, path)
