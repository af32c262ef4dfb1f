"""Query catalogue: what the driver runs, each with its SQL twin."""
