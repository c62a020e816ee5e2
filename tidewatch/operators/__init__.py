"""Operators on whole tables: ``DataFrame`` in, ``DataFrame`` or small fitted state out."""
