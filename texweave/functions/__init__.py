"""Column expressions: text, markup, images, metrics."""
