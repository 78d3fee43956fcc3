"""Column expressions; all of them stay inside the JVM except the distribution tails."""
