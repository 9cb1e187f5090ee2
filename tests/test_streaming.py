import json

from pyspark.sql import functions as F

from captionloom.functions.schemas import EMBEDDED
from captionloom.operators import points, validate, vectors
from captionloom.sources import messages
from captionloom.streaming import streams
from tests.test_operators import GOOD


def write_lines(folder, *groups):
    folder.mkdir()
    for k, rows in enumerate(groups):
        (folder / f"{k}.txt").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_validate_embed_upsert(spark, tmp_path):
    ids = [f"00000000-0000-4000-8000-00000000000{k}" for k in range(4)]
    write_lines(tmp_path / "in", [GOOD | {"doc_chunk_id": ids[0]}, "{broken"], [GOOD | {"doc_chunk_id": ids[1]}, GOOD | {"lang": ""}], [GOOD | {"doc_chunk_id": ids[0], "text": "again"}])
    at = lambda x: str(tmp_path / x)
    streams.stream_validate(spark, at("in"), at("ok"), at("dlq"), at("c1"), files_per_trigger=1).awaitTermination()
    batch = validate.validate_messages(messages.read_chunk_messages(spark, at("in")))
    good = spark.read.option("recursiveFileLookup", True).text(at("ok"))
    assert good.count() == batch.where("reason IS NULL").count() == 3
    assert sorted(r.reason for r in spark.read.json(at("dlq")).collect()) == ["invalid_json", "missing_lang"]
    streams.stream_validate(spark, at("in"), at("ok"), at("dlq"), at("c1")).awaitTermination()  # nothing new, nothing twice
    assert spark.read.option("recursiveFileLookup", True).text(at("ok")).count() == 3

    source = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).text(at("ok"))
    typed = validate.accepted(validate.validate_messages(messages.parse_messages(source)))
    streams.stream_embed(typed, at("items"), at("dlq2"), at("c2"), "hashed", dim=16).awaitTermination()
    items = spark.read.parquet(at("items"))
    assert items.count() == 3 and "text" not in items.schema["payload"].dataType.names
    same = vectors.embed(typed_batch := validate.accepted(batch), "text", None, 16)
    assert {tuple(r.vector) for r in items.select("vector").collect()} == {tuple(r.vector) for r in same.select("vector").collect()} and typed_batch.count() == 3

    schema = spark.read.parquet(at("items")).schema
    stream = spark.readStream.schema(schema).parquet(at("items")).withColumn("order", F.col("payload.created_at").cast("long"))
    streams.stream_upsert(stream, at("points"), at("c3"), "order", dim=16).awaitTermination()
    assert {r.id for r in points.read_points(spark, at("points")).collect()} == set(ids[:2])
    assert EMBEDDED.startswith("id string")


def test_rates_and_status(spark, tmp_path):
    from captionloom.operators import jobs

    rows = [{"event_id": k, "ts": f"2025-01-01T00:{k:02d}:00Z", "job_id": "ab"[k % 2], "type": "state", "data": json.dumps({"state": "done" if k > 5 else "running"})} for k in range(12)]
    write_lines(tmp_path / "ev", rows[:5], rows[5:])
    schema = "event_id long, ts timestamp, job_id string, type string, data string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "ev"))
    table = spark.read.schema(schema).json(str(tmp_path / "ev"))
    for name, f in (("rates", lambda d: streams.throughput(d, 300, F.col("event_id") % 2 == 1)), ("states", jobs.job_status)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, f(table).collect()))
