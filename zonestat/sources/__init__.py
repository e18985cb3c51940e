"""Sources and sinks: request URLs with pushed-down constraints, table readers, writers."""
