"""End-to-end dataflows composed of operators."""
