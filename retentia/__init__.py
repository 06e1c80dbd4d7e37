"""retentia: chromatogram-library analytics as Spark DataFrame operators."""
