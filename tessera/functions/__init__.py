"""Column functions: paths, names, code text, ranks.  All stay in the JVM."""
