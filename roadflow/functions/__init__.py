"""Column-expression builders (JVM-side, codegen friendly; no Python UDFs)."""

from roadflow.functions.calendar import (  # noqa: F401
    cyclic, is_holiday, is_weekend, kelvin_to_c, late_night,
    minute_label, night, parse_ts, quarter_of_month, rush_hour,
)
from roadflow.functions.levels import (  # noqa: F401
    clamp, corr_tag, cut, factors, fit_status, fixed_bins, level, level_color,
    level_emoji, period, risk, temp_bin, window_name,
)
