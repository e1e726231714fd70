"""Column expressions. Everything here stays inside the JVM; nothing needs a Python worker."""
