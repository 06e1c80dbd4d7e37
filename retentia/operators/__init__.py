"""operators of retentia."""
