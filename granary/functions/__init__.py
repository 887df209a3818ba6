"""Pure functions of bytes, without Spark."""
