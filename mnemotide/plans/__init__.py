"""Query catalogues over the driver tables."""
