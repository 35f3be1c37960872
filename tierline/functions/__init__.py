"""Column -> Column helpers: text cleaning, business formulae, value maps."""
