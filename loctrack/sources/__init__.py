from loctrack.sources.codec import (  # noqa: F401
    batches_to_json, explode_batches, parse_flat_updates, parse_locations, read_raw_updates, write_batches,
)
from loctrack.sources.files import (  # noqa: F401
    delivery_metrics_text, publish_metrics_text, read_app_logs, read_delivery_metrics, read_heap_recordings,
    read_publish_metrics, write_delivery_metrics, write_publish_metrics,
)
