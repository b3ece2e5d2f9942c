from loctrack.functions.columns import (  # noqa: F401
    ceil_div, clock12_text, epoch_ms, epoch_ms_ntz, fixed6_text, floor_div, grid_ceil, grid_floor, in_range,
    is_valid_uuid, join_ids, ms_text, ms_to_ts, rfc3339_text, split_ids, uuid_from_hex,
)
