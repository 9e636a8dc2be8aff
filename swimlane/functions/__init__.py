"""Column functions: all of them JVM-side expressions."""
