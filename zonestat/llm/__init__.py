"""Training-data operators: text dedup, classification, mixing, media and tokens.

Nothing else in zonestat imports this subpackage.
"""
