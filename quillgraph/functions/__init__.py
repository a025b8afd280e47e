"""See the package docstring of quillgraph."""
