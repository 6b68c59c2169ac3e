"""Schemas of the library's tables, declared once."""

ARTICLE = (
    "doc_id string, url string, title string, updated_at string, published_at string, breadcrumbs array<string>, tags array<string>, summary string, "
    "body_markdown string, body_text string, attachments array<struct<name:string,url:string>>, related_links array<struct<label:string,url:string>>, "
    "source string, source_host string, content_hash string"
)
STORED_ARTICLE = ARTICLE + ", scraped_at string, raw_html_path string"
CHUNK = (
    "chunk_id string, doc_id string, url string, title string, heading_path array<string>, section string, text string, tokens_estimate int, "
    "updated_at string, breadcrumbs array<string>, tags array<string>, source string, source_host string, scraped_at string, content_hash string"
)
CACHE = "url string, doc_id string, content_hash string, updated_at string, etag string, last_modified string, last_scraped string, status string, error string"
CRAWL_STATUSES = ("success", "blocked", "error", "auth_required")
CRAWL_ERROR = "url string, error string, timestamp string"
URL_DOCUMENT = "count long, urls array<string>"
USAGE = "inputTokens double, outputTokens double, totalTokens double"
