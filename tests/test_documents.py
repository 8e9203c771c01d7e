import pytest
from pyspark.sql import functions as F

from quern.operators import documents as d
from quern.sources.store import Store

NOW = 2_000_000_000


def docs(spark, *rows):
    """(id, user, hash, status, created)"""
    df = spark.createDataFrame(rows or [("", "", "", "", 0)], "id string, user_id string, content_hash string, status string, created long")
    full = df.select("id", "user_id", F.concat("id", F.lit(".pdf")).alias("filename"), "status", "content_hash", F.timestamp_seconds("created").alias("created_at"))
    out = full.select(*(F.col(f.name).cast(f.dataType) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in d.DOCUMENTS))
    return out if rows else out.limit(0)


def test_reads(spark):
    t = docs(spark, ("1", "a", "h", "ready", 1), ("2", "a", "h", "failed", 0), ("3", "b", "h", "ready", 2))
    assert [r.id for r in d.listing(t, "a").collect()] == ["1", "2"] and [r.id for r in d.listing(t, "").collect()] == ["3", "1", "2"]
    assert d.listing(t).first().title == ""
    assert d.get(t, "3", "a").isEmpty() and not d.get(t, "3").isEmpty()
    assert d.by_hash(t, "h", "a").first().id == "1"


def test_upsert_keeps_what_is_not_updatable(spark):
    t = docs(spark, ("1", "a", "h", "pending", 1))
    saved = docs(spark, ("1", "z", "other", "ready", 9), ("2", "b", "k", "pending", 5))
    out = {r.id: r for r in d.upsert(t, saved, now=F.timestamp_seconds(F.lit(NOW))).collect()}
    assert (out["1"].user_id, out["1"].content_hash, out["1"].status) == ("a", "h", "ready") and out["1"].updated_at is not None
    assert out["2"].updated_at is None and out["2"].user_id == "b"
    assert d.upsert(docs(spark), saved).count() == 2


def test_delete_cascades_within_scope(spark):
    t = docs(spark, ("1", "a", "h", "ready", 1), ("2", "b", "h", "ready", 1))
    c = spark.createDataFrame([("1", 0), ("2", 0)], "document_id string, idx int")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    left, chunks, gone = d.delete(t, c, ids, "a")
    assert [r.id for r in left.collect()] == ["2"] and [r.document_id for r in chunks.collect()] == ["2"] and [r.id for r in gone.collect()] == ["1"]


def test_queue(spark):
    t = docs(spark, ("1", "a", "h", "pending", 5), ("2", "a", "h", "pending", 3), ("3", "a", "h", "processing", 1))
    after, taken = d.claim(t, 1, now=F.timestamp_seconds(F.lit(NOW)))
    assert [r.id for r in taken.collect()] == ["2"] and {r.id: r.status for r in after.collect()}["2"] == "processing"
    every, all_taken = d.claim(t, None, now=F.timestamp_seconds(F.lit(NOW)))
    assert {r.id for r in all_taken.collect()} == {"1", "2"} and {r.status for r in every.collect()} == {"processing"} and all_taken.columns == t.columns
    again, n = d.reset_processing(after)
    assert n.first().n == 2 and {r.status for r in again.collect()} == {"pending"}
    failed = {r.id: (r.status, r.error) for r in d.fail(t, spark.createDataFrame([("1", "boom")], "id string, message string")).collect()}
    assert failed["1"] == ("failed", "boom") and failed["2"] == ("pending", None)
    assert d.migrate_owner(docs(spark, ("1", "local", "h", "ready", 1))).first().user_id == "admin"


def uploads(spark, *rows):
    return spark.createDataFrame(rows, "user_id string, filename string, content_hash string, size_bytes long, arrival string").withColumns({"chunk_size": F.lit(800), "chunk_overlap": F.lit(150)})


def test_accept(spark):
    t = docs(spark, ("old", "a", "h1", "ready", 1), ("bad", "a", "h2", "failed", 1))
    batch = uploads(spark, ("a", "x.pdf", "h1", 1, "1"), ("a", "y.PDF", "h2", 1, "2"), ("a", "z.txt", "h3", 1, "3"), ("a", "big.pdf", "h4", 99 << 20, "4"), ("b", "x.pdf", "h1", 1, "5"), ("b", "again.pdf", "h1", 1, "6"))
    fresh, verdicts = d.accept(t, batch)
    got = {r.arrival: (r.status, r.id) for r in verdicts.collect()}
    assert [got[k][0] for k in "123456"] == ["duplicate", "pending", "failed", "failed", "pending", "duplicate"]
    assert got["1"][1] == "old" and got["6"][1] == got["5"][1] and got["3"][1] is None
    assert fresh.count() == 2 and {r.status for r in fresh.collect()} == {"pending"}
    assert {r.id for r in d.accept(t, batch)[0].collect()} == {r.id for r in fresh.collect()}
    s = d.upload_summary(verdicts).first()
    assert (s.total, s.success, s.failed, s.duplicate) == (6, 4, 2, 2)
    once = d.accept(t.unionByName(fresh), batch)[1]
    assert once.where("status = 'pending'").isEmpty()


def test_chunk_parameters():
    assert d.resolve_chunking((800, 150), None) == (800, 150)
    assert d.resolve_chunking((800, 150), (400, None), (600, 100)) == (400, 100)
    assert d.resolve_chunking((800, 150), (100, None)) == (100, 25)
    for wish in ((0, None), (None, -1), (100, 100)):
        with pytest.raises(d.InvalidChunking):
            d.resolve_chunking((800, 150), wish)


def test_store_changes_all_or_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("documents").count() == 0
    s.write(documents=docs(spark, ("1", "a", "h", "ready", 1)))
    held = s.read("documents")
    with pytest.raises(Exception, match="boom"):
        s.write(documents=docs(spark, ("2", "a", "h", "ready", 1)).withColumn("id", F.raise_error(F.lit("boom")).cast("string")))
    assert [r.id for r in s.read("documents").collect()] == ["1"]
    s.write(documents=s.read("documents").unionByName(docs(spark, ("2", "a", "h", "ready", 1))))
    assert s.read("documents").count() == 2 and held.count() == 1
    assert s.vacuum() > 0 and s.read("documents").count() == 2 and s.vacuum() == 0


def test_a_change_rewrites_the_buckets_of_its_ids_alone(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.write(documents=docs(spark, *((str(i), "a", "h", "ready", i) for i in range(40))))
    before = s._state()["tables"]["documents"]
    ids = spark.createDataFrame([("3",), ("new",)], "id string")
    new = docs(spark, ("new", "b", "k", "pending", 1))
    assert s.change(ids, documents=lambda held: held.where("id <> '3'").unionByName(new)) <= 2
    after = s._state()["tables"]["documents"]
    assert sum(before.get(k) != after.get(k) for k in set(before) | set(after)) <= 2
    assert sorted(r.id for r in s.read("documents").collect()) == sorted([str(i) for i in range(40) if i != 3] + ["new"])
    s.append(documents=docs(spark, ("late", "b", "k", "pending", 2)))
    assert s.read("documents").count() == 41
    assert s.change(ids.limit(0), documents=lambda held: held.limit(0)) == 0
    with pytest.raises(ValueError):
        s.change(ids.where("id = '3'"), documents=lambda held: docs(spark, *((str(i), "a", "h", "ready", i) for i in range(40))))
    assert s.read("documents").count() == 41


def test_a_store_survives_a_writer_that_stops_anywhere(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write(documents=docs(spark, ("1", "a", "h", "ready", 1)))
    (tmp_path / "new-0.json").write_text('{"tables"')  # stopped before the pointer stood
    (tmp_path / "documents" / "half" / "_bucket=1").mkdir(parents=True)  # and while rows were written
    (tmp_path / "pointer-00000000000000000002.json").write_text('{"tab')  # a pointer that a crash has cut
    assert [r.id for r in s.read("documents").collect()] == ["1"]
    s.append(documents=docs(spark, ("2", "a", "h", "ready", 1)))
    assert s.read("documents").count() == 2
    s.vacuum()
    assert s.read("documents").count() == 2 and not (tmp_path / "new-0.json").exists()
