"""Scalar functions: every one builds Column expressions, so all of them stay
inside whole-stage code generation."""
