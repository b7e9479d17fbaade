"""Column-to-Column functions (JVM-side expressions, no Python UDFs)."""
