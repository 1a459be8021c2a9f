"""Schemas of the records that live in files; readers never infer."""

PACKET_LOG_608 = "ts DOUBLE, text STRING, frames ARRAY<STRUCT<b1: INT, b2: INT, note: STRING>>"

PACKET_LOG_708 = ("ts DOUBLE, text STRING, raw_hex STRING, "
                  "cc_data ARRAY<STRUCT<cc_type: INT, d1: INT, d2: INT, type_name: STRING>>")

BACKEND_WORDS = ("session_id BIGINT, utterance_id BIGINT, step INT, ok BOOLEAN, words ARRAY<STRUCT<word: STRING, "
                 "start: DOUBLE, end: DOUBLE, start_offset: INT, end_offset: INT>>")

ARCHIVE = ("id STRING, url STRING, video_id STRING, source_type STRING, created_at DOUBLE, status STRING, "
           "accuracy DOUBLE, segment_count INT, cue_count INT, accuracy_summary STRUCT<wer: DOUBLE, accuracy: DOUBLE, "
           "ref_words: BIGINT, substitutions: BIGINT, deletions: BIGINT, insertions: BIGINT, segment_count: BIGINT>, "
           "records ARRAY<STRING>, first_cue BIGINT, cues ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>")

INDEX = ("id STRING, url STRING, video_id STRING, source_type STRING, created_at DOUBLE, status STRING, accuracy DOUBLE, segment_count INT, "
         "cue_count INT")

INDEX_FIELDS = [field.split()[0] for field in INDEX.split(", ")]

GPU_COLUMNS = ["index", "name", "util_gpu", "util_mem", "mem_used_mb", "mem_total_mb", "temp_c", "power_w",
               "power_limit_w", "fan_pct", "clock_sm_mhz", "clock_mem_mhz"]
