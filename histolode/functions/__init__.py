"""Column expressions and rule tables shared by the operators."""
