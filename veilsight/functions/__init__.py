"""Column functions: validators, shapes and text helpers, all evaluated in the JVM."""
