"""Column functions: text, vectors and scores. All run inside the JVM."""
