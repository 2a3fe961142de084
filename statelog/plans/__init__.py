"""Query catalogues."""
