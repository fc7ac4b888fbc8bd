"""Column functions: strings in, typed values out, all inside code generation."""
