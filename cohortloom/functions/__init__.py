"""Column functions; each returns a Spark Column and keeps to JVM-side expressions."""
