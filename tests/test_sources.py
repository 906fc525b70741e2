"""Scans of recordings and documents, and checks of requests."""

import io
import wave

from pyspark.sql import functions as F

from talkloom.sources import calls, sinks


def wav(seconds):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\0\0" * int(16000 * seconds))
    return out.getvalue()


def test_scan(spark, tmp_path):
    root = tmp_path / "calls"
    (root / "sub" / ".talkloom").mkdir(parents=True)
    (root / "external-101-0912-20240102-030405-77.WAV").write_bytes(wav(2))
    (root / "sub" / "short.wav").write_bytes(wav(0.1))
    (root / "same.mp3").write_bytes(b"x")
    (root / "same.wav").write_bytes(b"y")
    (root / "sub" / ".talkloom" / "hidden.wav").write_bytes(wav(1))
    (root / "notes.txt").write_text("no")
    (root / "sub" / "short.md").write_text("# text")
    (root / "same.md").write_text("# ambiguous")
    (root / "sub" / "run.json").write_text('{"a": 1}')
    (root / "sub" / "bad.json").write_text("{")
    got = {r.filename: r for r in calls.scan(spark, str(root)).collect()}
    assert set(got) == {"external-101-0912-20240102-030405-77.WAV", "short.wav", "same.mp3", "same.wav"}
    first = got["external-101-0912-20240102-030405-77.WAV"]
    assert (first.direction, first.duration_seconds, first.channels) == ("inbound", 2.0, 1) and len(first.content_sha256) == 64
    assert got["same.mp3"].collision and got["same.mp3"].metadata_error and not got["short.wav"].collision
    scanned = calls.scan(spark, str(root))
    c = calls.scan_counters(scanned, scanned.where("false")).first()
    assert (c.discovered, c.created, c.collisions, c.skipped) == (4, 2, 2, 3)
    assert [r.content for r in calls.sidecars(spark, str(root), scanned).collect()] == ["# text"]
    docs = {r.path.rsplit("/", 1)[1]: r.invalid for r in calls.run_documents(spark, str(root)).collect()}
    assert docs == {"run.json": False, "bad.json": True}


def test_scan_into_the_tables(spark, tmp_path):
    """Two scans of a folder that changes: new, changed, short, colliding, broken and gone recordings, documents beside them."""
    from talkloom import schemas
    from talkloom.sources import snapshots

    root, now = tmp_path / "calls", F.current_timestamp()
    root.mkdir()
    (root / "a b.wav").write_bytes(wav(2))
    (root / "a b.md").write_text("first text")
    (root / "short.wav").write_bytes(wav(0.2))
    (root / "short.md").write_text("not imported")
    (root / "same.mp3").write_bytes(b"x")
    (root / "same.WAV").write_bytes(wav(1))
    (root / "broken.ogg").write_bytes(b"no")
    (root / "broken.md").write_text(" \n ")
    (root / "other.bin").write_bytes(b"not read")
    empty = lambda s: spark.createDataFrame([], s)
    store = snapshots.Store(spark, str(tmp_path / "store"))
    store.commit(store.read(), {"audio_files": empty(schemas.CALLS), "jobs": empty(schemas.JOBS), "transcripts": empty(schemas.TRANSCRIPTS)})

    def scan():
        counted = []

        def change(tables):
            out, counters = calls.scan_into(spark, str(root), tables, now)
            counted[:] = counters.collect()
            return out

        store.transact(change)
        return counted[0].asDict(), store.read().tables

    counters, t = scan()
    assert counters == {"discovered": 5, "changed": 3, "metadata_errors": 3, "skipped": 3, "collisions": 2, "imported_markdown": 1}
    status = lambda t: {r.filename: r.status for r in t["audio_files"].join(t["jobs"].select(F.col("audio_file_id").alias("id"), "status"), "id").collect()}
    assert status(t) == {"a b.wav": "completed", "short.wav": "skipped", "broken.ogg": "pending"}
    assert [(r.version, r.content, r.is_current, r.source) for r in t["transcripts"].collect()] == [(1, "first text", True, "existing_markdown")]
    (root / "a b.wav").write_bytes(wav(3))
    (root / "broken.md").write_text("second")
    (root / "short.wav").unlink()
    (root / "same.mp3").unlink()
    counters, t = scan()
    assert counters == {"discovered": 3, "changed": 2, "metadata_errors": 1, "skipped": 0, "collisions": 0, "imported_markdown": 1}
    assert status(t) == {"a b.wav": "pending", "short.wav": "skipped", "broken.ogg": "completed", "same.WAV": "pending"}
    assert sorted((r.content, r.is_current) for r in t["transcripts"].collect()) == [("first text", False), ("second", True)]
    counters, t = scan()
    assert counters["changed"] == 0 and counters["imported_markdown"] == 1  # the document beside the recording that had changed
    assert sorted((r.content, r.version, r.is_current) for r in t["transcripts"].collect()) == [("first text", 1, False), ("first text", 2, True), ("second", 1, True)]


def test_publishing(spark, tmp_path):
    p = spark.createDataFrame([(1, "x"), (2, "y")], "audio_file_id long, content string")
    base = spark.createDataFrame([(1, "h1"), (2, "h2")], "audio_file_id long, content_hash string")
    disk = spark.createDataFrame([(1, "edited"), (2, "h2")], "audio_file_id long, content_hash string")
    assert [r.audio_file_id for r in sinks.publishable(p, base, disk).collect()] == [2]
    where = sinks.publish_snapshot({"p": p}, str(tmp_path), 3)
    assert spark.read.parquet(f"{where}/p").count() == 2
    assert spark.range(1).select(sinks.byte_range(F.lit(b"abcdef"), 1, 3).alias("b")).first().b == b"bcd"
