"""Schemas of the stored tables and nested documents, declared once."""

WORD = "struct<word:string,start:double,end:double,probability:double>"
CALLS = "id long, absolute_path string, relative_path string, filename string, direction string, agent_extension string, remote_number string, call_id string, recorded_at timestamp_ntz, size_bytes long, mtime_ns long, content_sha256 string, duration_seconds double, codec string, bitrate long, sample_rate long, channels long, metadata_error string, discovered_at timestamp, updated_at timestamp"
JOBS = "id long, audio_file_id long, stage string, status string, priority long, attempts long, max_attempts long, claimed_by string, claimed_at timestamp, lease_expires_at timestamp, last_error string, created_at timestamp, updated_at timestamp"
RUNS = "id long, job_id long, audio_file_id long, stage string, status string, worker_id string, attempt long, thread_id string, log_path string, stderr_path string, error string, started_at timestamp, finished_at timestamp"
TRANSCRIPTS = "id long, audio_file_id long, processing_run_id long, version long, content string, format string, language string, source string, content_hash string, audio_content_hash string, markdown_path string, unclear_count long, is_current boolean, created_at timestamp"
REVIEWS = "transcript_id long, status string, reviewer string, notes string, data_json string, base_transcript_id long, markdown_synced boolean, created_at timestamp"
CORRECTIONS = "id long, audio_file_id long, source_transcript_id long, result_transcript_id long, segment_id string, start_seconds double, end_seconds double, original_text string, corrected_text string, selection_source string, candidate_id string, candidates_json string, evidence_json string, reviewer string, created_at timestamp"
ARTIFACTS = "id long, audio_file_id long, processing_run_id long, transcript_id long, kind string, path string, content_hash string, metadata_json string, created_at timestamp"
EVENT = "struct<type:string,stage:string,state:string,message:string,error:string,timestamp:string,item:struct<type:string,status:string,command:string,exit_code:long,text:string,aggregated_output:string>>"
