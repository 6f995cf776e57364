"""The expression language: parsing and compiling to DataFrame plans."""
