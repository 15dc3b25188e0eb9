"""Operators over tables: generate, evaluate, survey, gaps, repair, verify, audit, lint."""
