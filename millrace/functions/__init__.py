"""Column functions: all but ``nfkc`` stay inside the JVM."""
