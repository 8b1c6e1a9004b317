"""Column expressions: text, numbers, maps and time. All of them stay in the JVM."""
