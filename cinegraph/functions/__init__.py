"""Native Column expressions (no per-row Python)."""
