"""Scalar functions as columns; all run inside the JVM unless their docstring says otherwise."""
