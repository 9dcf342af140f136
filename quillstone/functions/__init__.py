"""Column functions: codecs of attribute types, text helpers and formulas."""
