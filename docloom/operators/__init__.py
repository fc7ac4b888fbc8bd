"""Operators on frames: tables, neighbours, detection, retrieval, mapping and evaluation."""
