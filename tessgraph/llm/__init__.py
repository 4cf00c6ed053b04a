"""Training-data operators. Nothing outside this subpackage (and the pipeline file) imports it."""
