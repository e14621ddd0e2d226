from groupcast.functions.columns import (  # noqa: F401
    hash_uniform,
    laplace_from_uniform,
    safe_div,
    sign,
)
from groupcast.functions.arrays import (  # noqa: F401
    array_cdf,
    array_l1,
    array_l2_norm,
    array_sum,
    clip_l2,
    ema_combine,
    normalise_distribution,
)
