"""Column functions: Column in, Column out; all of them run inside the JVM."""
