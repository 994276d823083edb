"""Column expressions: pure functions from columns to columns, all evaluated in the JVM."""
