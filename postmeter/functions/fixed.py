"""Fixed values that results depend on: names, codes, patterns, offsets."""

from __future__ import annotations

# Metric type codes.
TYPE_PLUGIN = 3
TYPE_HOST = 4


def variable_patterns(agent: str) -> list[str]:
    """LIKE patterns of the server variables worth keeping; ``agent`` prefixes its own settings.

    Fixed values, in their order of use.
    """
    return [
        r"auto\_increment%",
        r"binlog\_format",
        r"character\_set\_%",
        r"collation%",
        r"engine\_condition\_pushdown",
        r"event\_scheduler",
        agent + r"\_%",
        r"ft\_m%",
        r"have\_%",
        r"%\_size",
        r"innodb_f%",
        r"%\_length%",
        r"%\_timeout",
        r"large\_%",
        r"lc_time_names",
        r"log",
        r"log_bin",
        r"log_output",
        r"log_slow_queries",
        r"log_slow_time",
        r"lower_case%",
        r"max_allowed_packet",
        r"max_connections",
        r"max_prepared_stmt_count",
        r"max_sp_recursion_depth",
        r"max_user_connections",
        r"max_write_lock_count",
        r"myisam_recover_options",
        r"myisam_repair_threads",
        r"myisam_stats_method",
        r"myisam_use_mmap",
        r"net\_%",
        r"new",
        r"old%",
        r"optimizer%",
        r"profiling",
        r"query_cache%",
        r"secure_auth",
        r"slow_launch_time",
        r"sql%",
        r"storage_engine",
        r"sync_binlog",
        r"table_definition_cache",
        r"table_open_cache",
        r"thread_handling",
        r"time_zone",
        r"timed_mutexes",
        r"version%",
    ]


# Report section, content suffix, batches between two sends, switch.
SECTIONS = [
    ("history", "history", 1, "always"),
    ("queries", "queries", 30, "query"),
    ("status", "status", 2, "status"),
    ("variables", "variables", 60, "variable"),
    ("explain", "explain", 30, "query"),
    ("master", "master", 1, "replication"),
    ("slave", "slave", 1, "replication"),
    ("columns", "columns", 80, "schema"),
    ("tables", "tables", 80, "schema"),
    ("dict", "dict", 80, "dictionary"),
    ("key_column", "key_column", 80, "dictionary"),
]

# Seconds between two samples per kind.
CADENCE = {
    "query": 120,
    "explain": 300,
    "schema": 120,
    "replication": 5,
    "variable": 30,
    "status": 2,
}

# Default port per scheme.
DEFAULT_PORTS = {"mysql": 3306, "mysqls": 3306, "http": 80, "https": 443, "smtp": 25, "smtps": 587}

# Host facts in report order (column of the host table, metric name).
HOST_FACTS = [
    ("cpu_count", "Cpu_count"),
    ("mem_total", "Mem_total"),
    ("now", "Now"),
    ("sysname", "Uname_sysname"),
    ("release", "Uname_release"),
    ("version", "Uname_version"),
    ("machine", "Uname_machine"),
    ("distribution", "Uname_distribution"),
]

# Suffix to MIME type.
MIME_TYPES = {
    ".html": "text/html",
    ".htm": "text/html",
    ".shtm": "text/html",
    ".shtml": "text/html",
    ".css": "text/css",
    ".js": "application/x-javascript",
    ".ico": "image/x-icon",
    ".gif": "image/gif",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".svg": "image/svg+xml",
    ".txt": "text/plain",
    ".torrent": "application/x-bittorrent",
    ".wav": "audio/x-wav",
    ".mp3": "audio/x-mp3",
    ".mid": "audio/mid",
    ".m3u": "audio/x-mpegurl",
    ".ogg": "application/ogg",
    ".ram": "audio/x-pn-realaudio",
    ".xml": "text/xml",
    ".json": "text/json",
    ".xslt": "application/xml",
    ".xsl": "application/xml",
    ".ra": "audio/x-pn-realaudio",
    ".doc": "application/msword",
    ".exe": "application/octet-stream",
    ".zip": "application/x-zip-compressed",
    ".xls": "application/excel",
    ".tgz": "application/x-tar-gz",
    ".tar": "application/x-tar",
    ".gz": "application/x-gunzip",
    ".arj": "application/x-arj-compressed",
    ".rar": "application/x-arj-compressed",
    ".rtf": "application/rtf",
    ".pdf": "application/pdf",
    ".swf": "application/x-shockwave-flash",
    ".mpg": "video/mpeg",
    ".webm": "video/webm",
    ".mpeg": "video/mpeg",
    ".mov": "video/quicktime",
    ".mp4": "video/mp4",
    ".m4v": "video/x-m4v",
    ".asf": "video/x-ms-asf",
    ".avi": "video/x-msvideo",
    ".bmp": "image/bmp",
    ".ttf": "application/x-font-ttf",
}

# HTTP status to reason text; anything else reads as 500.
REASONS = {
    200: "OK",
    201: "Created",
    204: "No Content",
    301: "Moved Permanently",
    302: "Found",
    304: "Not Modified",
    400: "Bad Request",
    403: "Forbidden",
    404: "Not Found",
    405: "Method Not Allowed",
    409: "Conflict",
    411: "Length Required",
    413: "Request Entity Too Large",
    415: "Unsupported Media Type",
    423: "Locked",
    500: "Server Error",
    501: "Not Implemented",
}
DEFAULT_REASON = "Server Error"

# Request methods a server accepts.
HTTP_METHODS = ["GET", "POST", "HEAD", "CONNECT", "PUT", "DELETE", "OPTIONS", "PROPFIND", "MKCOL"]

# Header field to value type; every other field is text.
HEADER_TYPES = {
    "from": "mailbox",
    "to": "address_list",
    "cc": "address_list",
    "bcc": "address_list",
    "sender": "mailbox",
    "date": "datetime",
    "received": "relay",
    "subject": "text",
    "reply-to": "mailbox",
    "delivered-to": "mailbox",
    "organization": "text",
    "user-agent": "text",
    "return-path": "path",
    "content-type": "media_type",
    "content-transfer-encoding": "encoding",
    "content-description": "text",
    "mime-version": "text",
    "content-disposition": "disposition",
    "content-id": "message_id",
    "message-id": "message_id",
    "content-location": "text",
    "in-reply-to": "message_id_sequence",
    "references": "message_id_sequence",
    "original-message-id": "message_id",
    "disposition": "receipt_disposition",
    "disposition-notification-to": "mailbox_list",
}

# Message flag bits, their file-name letter and server keyword.
FLAG_BITS = {
    "SEEN": 1,
    "RECENT": 2,
    "DELETED": 4,
    "REPLIED": 8,
    "MARKED": 16,
    "PASSED": 32,
    "DRAFT": 64,
}
FLAG_LETTERS = {"F": 16, "P": 32, "R": 8, "S": 1, "T": 4, "D": 64}
FLAG_KEYWORDS = [
    (8, "\\Answered"),
    (16, "\\Flagged"),
    (4, "\\Deleted"),
    (1, "\\Seen"),
    (64, "\\Draft"),
]

# Folder special uses by server keyword.
SPECIAL_USES = {
    "\\all": "all",
    "\\archive": "archive",
    "\\drafts": "drafts",
    "\\flagged": "flagged",
    "\\junk": "junk",
    "\\sent": "sent",
    "\\trash": "trash",
    "\\important": "important",
}
