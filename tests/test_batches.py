"""Python tasks hold a bounded part of an Arrow batch at a time, however many rows the batch has."""

import pyarrow as pa
from pyspark.sql import functions as F

from captionloom.functions import batches
from captionloom.operators import chunks, vectors


def test_parts():
    held = pa.RecordBatch.from_pydict({"k": list(range(6)), "x": ["", "abc", None, "d" * 50, "ef", "gh"]})
    assert [p.column("k").to_pylist() for p in batches.parts(held, "x", 6)] == [[0, 1, 2], [3], [4, 5]]
    cues = [[{"start": 1, "end": 2, "text": "a"}], None, [], [{"start": 3, "end": 4, "text": None}, {"start": 5, "end": 6, "text": "b"}]]
    lists = pa.RecordBatch.from_arrays([pa.array(cues, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.float64()), ("text", pa.string())])))], ["c"])
    assert [list(batches.cues_of(p.column("c"))) for p in batches.parts(lists, "c", 3)] == [[[(1.0, 2.0, "a")], []], [[]], [[(3.0, 4.0, None), (5.0, 6.0, "b")]]]


class Caught:
    """Stands for a DataFrame: its mapInArrow() gives the function that tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_folds_take_parts(spark):
    """6,000 jobs of 20 cues in one batch are folded 20,000 cues at a time."""
    cues = [{"cue_no": k, "start": float(k), "end": k + 1.0, "text": f"cue {k}"} for k in range(20)]
    batch = pa.RecordBatch.from_pydict({"job_id": [str(k) for k in range(6000)], "cues": [cues] * 6000})
    made = list(chunks.pack_job_arrays(Caught(), 60)(iter([batch])))
    assert len(made) == 7 and sum(map(len, made)) == 6000 * len(list(chunks.pack([(c["start"], c["end"], c["text"]) for c in cues], 60)))


def test_embedding_takes_parts(spark):
    """Texts of 6 MB in one batch reach the encoder's loop 2 MB at a time; other columns pass as they are."""

    def make():
        import sys

        def encode(texts):
            loop = sys._getframe(2).f_locals["texts"]  # what run() holds
            assert sum(map(len, loop)) <= batches.TEXT
            return vectors.letter_counts()(texts)

        return encode

    docs = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("ab"), 1000).alias("text"), F.lit("2025-01-01").cast("timestamp").alias("at"), F.struct(F.array("id").alias("n")).alias("s"))
    out = vectors.embed(docs, make_encoder=make, dim=26).toPandas()
    assert out["embed_error"].isna().all() and sorted(out["id"]) == list(range(3000)) and all(s["n"] == [k] for k, s in zip(out["id"], out["s"]))
