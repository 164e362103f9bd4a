"""Question, page, price, prediction and review shapes derived from the driver tables."""
