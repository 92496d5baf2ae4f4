"""Part of docvet."""
