"""Operators for preparing training data: filtering, deduplication, packing, encoding.  Nothing outside imports this."""
