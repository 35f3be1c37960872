"""The warehouse models, one module per layer of the build."""
