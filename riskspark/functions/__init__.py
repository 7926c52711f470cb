"""Column -> Column helpers (JVM-side expressions, no Python UDFs)."""

from riskspark.functions.numeric import (  # noqa: F401
    argmax3_label,
    clamp01,
    percent_label,
    risk_level,
    round_half_away,
    softmax3,
)
from riskspark.functions.text import (  # noqa: F401
    clean_caption,
    clean_text,
    collapse_ws,
    keyword_hits,
    parse_count,
    strip_ws,
    to_bool,
    tokens,
)
