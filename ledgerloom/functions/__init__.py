"""Column builders: text cleaning, rules, taxonomy."""
