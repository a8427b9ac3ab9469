"""Table schemas of the document model."""

from __future__ import annotations

ITEMS = "item_id string, kind string, path string, image_count int, size long, sha256 string"
PROVENANCE = "struct<sha256:string,width:int,height:int,byte_size:long,effective_dpi:double,source_sha256:string>"
TRANSCRIPTIONS = f"item_id string, idx int, image string, sequence_number int, page_index int, text string, processing_time double, schema_retries map<string,int>, error string, error_type string, provider string, provenance {PROVENANCE}"
PAGE_INFORMATION = "struct<page_number_integer:int,is_two_page_spread:boolean,page_number_integer_end:int,page_number_type:string,page_types:array<string>>"
SUMMARIES = f"item_id string, idx int, page int, page_information {PAGE_INFORMATION}, bullet_points array<string>, references array<struct<citation:string,is_partial:boolean>>, error string"
MENTIONS = "item_id string, ord long, page int, raw string, is_partial boolean"
CITATIONS = "item_id string, key string, raw string, pages array<int>, unnumbered boolean, partial boolean, year int, volume int, author string, comparison_text string, variants array<string>"
USAGE_EVENTS = "ts timestamp, tool string, provider string, key_env string, model string, tokens long"
POOLS = "provider string, pool string, prefix string"
CAPS = "provider string, pool string, cap long"
RUNS = "item_id string, log_type string, format_version int, total_images int, model_name string, input_type string, provenance string"
