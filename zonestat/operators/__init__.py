"""operators of zonestat."""
