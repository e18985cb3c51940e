"""functions of zonestat."""
