"""Column functions. All take and return Columns and stay inside the JVM."""
