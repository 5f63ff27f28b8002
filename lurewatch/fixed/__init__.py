"""Word lists, lookup tables, thresholds and texts that results depend on."""
