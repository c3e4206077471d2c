"""Incremental batch (watermark, re-split, rerun-safe append) and its streaming twin."""
