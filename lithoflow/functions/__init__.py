"""Column expressions shared by readers and operators."""

from lithoflow.functions.strings import fields, first_number, has_suffix, parse_double, stem_first, stem_last, trim_ws, without

__all__ = ["fields", "first_number", "has_suffix", "parse_double", "stem_first", "stem_last", "trim_ws", "without"]
