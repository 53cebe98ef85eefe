"""Column -> Column expressions. Everything here stays JVM-side."""
