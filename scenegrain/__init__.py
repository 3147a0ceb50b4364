"""scenegrain: scene-graph derivation, evaluation and corpus preparation on PySpark."""
