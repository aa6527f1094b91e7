"""Whole plans: the detection pipeline, and the registered queries."""
