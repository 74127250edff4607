"""Training-data operators: LM scoring, deduplication, secret scans, HTML extraction,
token storage, packing, quality rules and byte-pair encoding.

Nothing outside this folder imports it; ``queries.py`` lists its queries for the driver.
"""
