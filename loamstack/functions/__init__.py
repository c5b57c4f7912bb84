"""Column functions: all of them expressions that Catalyst sees, save the YAML parser."""
