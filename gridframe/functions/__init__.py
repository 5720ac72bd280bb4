"""Column-expression builders (JVM-side, whole-stage codegen friendly)."""

from gridframe.functions.arrays import (  # noqa: F401
    block_count,
    ceil_div,
    dense_from_entries,
    dot,
    mask_equal,
    slice0,
)
from gridframe.functions.names import (  # noqa: F401
    archive_first_day,
    archive_last_day,
    archive_name_for,
    decoded_name,
    is_archive,
    join_path,
    record_name_for,
    record_time,
    record_time_ms,
)
