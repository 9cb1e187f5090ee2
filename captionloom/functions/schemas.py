"""Schemas of the tables that the jobs exchange."""

from __future__ import annotations

#: Caption formats that a request may prefer.
FORMATS = ("vtt", "ttml", "srv3", "srv2", "srv1", "json3", "srt")

CUE_ARRAY = "array<struct<start:double,end:double,text:string>>"
CHUNK = "job_id string, chunk_no int, text string, time_from double, time_to double"
#: Times are read as text and cast, since numbers written as text are numbers too.
MESSAGE_IN = "doc_chunk_id string, text string, user_id string, source string, title string, lang string, created_at string, source_url string, source_id string, video_timestamp struct<time_from:string,time_to:string>"
#: The fields that a message must have.
REQUIRED = ("doc_chunk_id", "text", "user_id", "source", "title", "lang", "created_at", "source_url", "source_id")
EMBEDDED = "id string, vector array<float>, payload struct<doc_chunk_id:string,user_id:string,source:string,title:string,lang:string,model:string,created_at:timestamp,source_url:string,source_id:string,video_timestamp:struct<time_from:double,time_to:double>>"
SILENCE = "job_id string, start double, end double, dur double, mid double"
PART = f"job_id string, idx int, cues {CUE_ARRAY}, lang string, error string"
SELECTED = "struct<lang:string,format:string,chain:string>"
JOB_METADATA = (
    "job_id string, video_id string, video_title string, source_url string, "
    f"stages struct<captions:struct<success:boolean,seconds:double,selected:{SELECTED}>,whisper:struct<success:boolean,seconds:double,stats:map<string,string>,lang:string>>, "
    "text_processing struct<method:string,selected_lang:string,captions_file:string,lang:string,srt_file:string,chunks:int,enqueued:int,queue:string,max_text_length:int,errors:array<string>>, "
    "success boolean, total_seconds double, error string"
)
