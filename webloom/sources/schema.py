"""Schemas of the stored relations, as DDL."""

POSTING = "word string, origin_url string, current_url string, depth int, frequency bigint, ts bigint"
#: What a line may hold before numbers are cast.
RAW_POSTING = "word string, origin_url string, current_url string, depth string, frequency string, ts string"
STATE = (
    "crawler_id string, origin string, state string, depth_limit int, queue_size int, queue array<struct<url: string, depth: int>>, visited_count int, "
    "visited_pages array<string>, pages_processed int, pages_indexed int, pages_failed int, logs array<string>, updated_at bigint"
)
PAGE = "url string, html string"
