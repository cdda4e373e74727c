"""Column functions over text and vectors; all stay in the JVM."""
