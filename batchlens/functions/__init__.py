"""Column-expression helpers (JVM-side, codegen friendly)."""

from batchlens.functions.numeric import (  # noqa: F401
    clip_keep_null,
    isclose0,
    nan_to_null,
    norm_expr,
    rint_dp,
    to_double,
)
from batchlens.functions.zones import zone_candidate, zone_feature  # noqa: F401
