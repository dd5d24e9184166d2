"""SQL expressions over Spark's own functions."""

from quartzline.functions.money import exact_total, hundredths, quoted

__all__ = ["exact_total", "hundredths", "quoted"]
