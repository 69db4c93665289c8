"""Training-data operators: mixing, packing, quality, dedup, extraction, scoring, scans."""
