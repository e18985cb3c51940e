"""plans of zonestat."""
