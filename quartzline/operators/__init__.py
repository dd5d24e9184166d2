"""DataFrame-to-DataFrame operators."""

from quartzline.operators.exact_sums import exact_sums

__all__ = ["exact_sums"]
