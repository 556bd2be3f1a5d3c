"""Column -> Column functions."""

from .formats import (  # noqa: F401
    content_type,
    file_extension,
    file_extension_simple,
    format_extension,
    format_mime,
    resolve_format,
)
from .images import bad_image_payload, image_data_uri, sniff_image_mime, strict_base64  # noqa: F401
from .keys import (  # noqa: F401
    cache_age,
    document_filename,
    local_location,
    object_key,
    object_location,
    request_summary,
    sortable_id,
)
from .redact import (  # noqa: F401
    file_name_of,
    human_bytes,
    sanitize_bucket,
    sanitize_error_message,
    sanitize_http_url,
    sanitize_map,
    sanitize_path,
    sanitize_s3_uri,
    sanitize_template_path,
)
from .uris import (  # noqa: F401
    cache_key,
    has_protocol,
    is_local,
    parse_s3_uri,
    path_after_colon,
    path_error_subject,
    path_is_unsafe,
    safe_name_fallback,
    strip_protocol,
    template_file_name,
    template_protocol,
)
