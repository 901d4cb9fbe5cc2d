"""Column functions: every one is a built-in expression, none needs a shuffle."""
