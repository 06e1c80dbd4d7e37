"""plans of retentia."""
