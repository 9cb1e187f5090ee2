import json
import zipfile

import pytest
from pyspark.sql import functions as F

from captionloom.operators import transcripts
from captionloom.sources import captions, subtitle_sink


def cues(spark, jobs):
    said = F.concat(F.lit("line "), "id", F.lit(" of "), "k")
    rows = spark.range(jobs).select(F.concat(F.lit("j"), "id").alias("job_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "id")
    return rows.select("job_id", F.col("k").alias("cue_no"), F.col("k").cast("double").alias("start"), (F.col("k") + 0.5).alias("end"), said.alias("text"))


def test_files_under_their_own_names(spark, tmp_path):
    at = str(tmp_path / "subs")
    made = cues(spark, 12)
    subtitle_sink.save_subtitles(transcripts.render_vtt(made), at)
    subtitle_sink.save_subtitles(transcripts.render_srt(made).withColumn("lang", F.lit("de")), at, ext="srt", mode="append")
    names = sorted(str(p.relative_to(at)) for p in (tmp_path / "subs").rglob("*") if p.is_file() and not p.name.endswith("SUCCESS"))
    assert names == sorted(f"j{k}/{n}" for k in range(12) for n in ("en.vtt", "de.srt"))
    back = captions.parse_captions(captions.read_caption_files(spark, at)).select("job_id", "cue_no", "start", "end", "text")
    assert sorted(map(tuple, back.where("path LIKE '%.vtt'").collect())) == sorted(map(tuple, made.collect())) and back.count() == 48
    subtitle_sink.save_subtitles(transcripts.render_vtt(made.where("job_id = 'j3'")), at)
    assert [p.name for p in (tmp_path / "subs").iterdir() if p.is_dir()] == ["j3"]


def test_many_jobs_in_archives(spark, tmp_path):
    at, made = str(tmp_path / "packed"), cues(spark, 10_000)
    subtitle_sink.save_subtitles(transcripts.render_vtt(made).repartition(3), at, "archive", archive_bytes=200_000)
    found = list((tmp_path / "packed").iterdir())
    assert len(found) < 30 and not [p for p in found if p.is_dir()] and json.loads((tmp_path / "packed" / "_SUCCESS").read_text()) == {"documents": 10_000}
    back = captions.parse_captions(subtitle_sink.read_caption_archives(spark, at)).select("job_id", "cue_no", "start", "end", "text")
    assert back.exceptAll(made.withColumn("cue_no", F.col("cue_no").cast("int"))).count() == 0 and back.count() == 20_000
    index = spark.read.json(f"{at}/*.index.json").where("job_id = 'j77'").collect()
    assert len(index) == 1
    with zipfile.ZipFile(f"{at}/{index[0].archive}") as z:
        assert b"line 77 of 1" in z.read(index[0].entry)


@pytest.mark.parametrize("layout", ["files", "archive"])
def test_a_failed_run_leaves_nothing(spark, tmp_path, layout):
    at = str(tmp_path / "subs")
    made = transcripts.render_vtt(cues(spark, 40))
    subtitle_sink.save_subtitles(made, at, layout)
    before = sorted(p.name for p in (tmp_path / "subs").rglob("*"))
    bad = made.repartition(4, "job_id").withColumn("value", F.when(F.col("job_id") == "j7", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        subtitle_sink.save_subtitles(bad, at, layout)
    assert sorted(p.name for p in (tmp_path / "subs").rglob("*")) == before
    with pytest.raises(Exception, match="no file can be named"):
        subtitle_sink.save_subtitles(made.withColumn("job_id", F.lit("../up")), at, layout)
    assert sorted(p.name for p in (tmp_path / "subs").rglob("*")) == before
    with pytest.raises(Exception, match="layout"):
        subtitle_sink.save_subtitles(made, at, "tar")
