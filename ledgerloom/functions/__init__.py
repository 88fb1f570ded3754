"""Column functions, all JVM-side unless a docstring says otherwise."""
