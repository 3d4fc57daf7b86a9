"""End-to-end builds and the registered queries."""
