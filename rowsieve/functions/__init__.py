"""Column helpers; all of them stay on the JVM side."""
