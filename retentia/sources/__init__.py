"""sources of retentia."""
