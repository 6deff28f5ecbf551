"""Micro-batch analysis and repeated scans."""
