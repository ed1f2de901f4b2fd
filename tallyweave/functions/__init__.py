"""Column-expression library; everything here stays inside JVM code generation."""
