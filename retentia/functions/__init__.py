"""functions of retentia."""
