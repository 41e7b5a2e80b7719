"""Column functions, all inside the JVM."""
