"""Column -> Column helpers."""

from murmur.functions.scalar import (  # noqa: F401
    bucket_by,
    log2_or_neg_inf,
    md5_bucket,
    md5_key,
    nullif_blank,
    quote,
    round_half_away,
    sentiment_bucket,
    views_bucket,
    views_bucket4,
)
from murmur.functions.text import (  # noqa: F401
    CASED_TOKEN_PATTERN,
    WORD_PATTERN,
    ngrams,
    tokens_cased,
    tokens_lower,
    tokens_parted,
)
