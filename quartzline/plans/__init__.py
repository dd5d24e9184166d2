"""Whole queries: operators put together over the tables."""

from quartzline.plans.pricing_summary import pricing_summary

__all__ = ["pricing_summary"]
