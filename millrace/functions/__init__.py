"""Scalar functions as Column expressions; only half_trim and url_join leave the JVM."""
