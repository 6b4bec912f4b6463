"""Column-level helpers (return ``Column`` expressions, stay JVM-side)."""
